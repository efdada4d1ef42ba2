"""The render loop over versions of a scene: a change composites again only the tiles that it touches.

The index has a row per splat and tile that its screen box meets, so what a tile shows is found by its key. A change (splats put in, moved
or taken out) makes the tiles of their old and new boxes dirty; fragments of those tiles alone are made and blended, and replace the
frame's pixels there. Without a scene nothing is drawn, and without a change the frame stays. A new camera starts over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.camera import Camera
from voxelloom.operators import raster as R
from voxelloom.session import discard, written

TILE = 16
_KEY = ["tile_x", "tile_y"]


def tile_index(splats: DataFrame, camera: Camera, tile: int = TILE) -> DataFrame:
    """Visible splats' ellipses, one row per tile that their box meets."""
    b = R.screen_box(R.visible(R.project(splats, camera), camera.width, camera.height), camera.width, camera.height).where("min_x <= max_x and min_y <= max_y")
    span = lambda a: F.explode(F.sequence(F.expr(f"min_{a} div {tile}").cast("int"), F.expr(f"max_{a} div {tile}").cast("int")))
    return b.withColumn("tile_y", span("y")).withColumn("tile_x", span("x"))


def tile_pixels(index: DataFrame, tile: int = TILE) -> DataFrame:
    """Fragments of the index rows, each within its tile: one row per splat and pixel that it colours."""
    for a in "xy":
        low = F.greatest(F.col(f"min_{a}"), F.col(f"tile_{a}") * tile)
        index = index.withColumn(a, F.explode(F.sequence(low, F.least(F.col(f"max_{a}"), F.col(f"tile_{a}") * tile + (tile - 1)))))
    return R.fragments(index)


@dataclass
class RenderLoop:
    """``frame``: x, y, r, g, b, a of lit pixels in 0..1. ``composited``: rows of the index that each drawing has read."""

    camera: Camera
    tile: int = TILE
    scene: DataFrame | None = None
    index: DataFrame | None = None
    frame: DataFrame | None = None
    composited: list[int] = field(default_factory=list)

    def show(self, scene: DataFrame | None) -> DataFrame | None:
        """A whole scene, drawn from nothing."""
        discard(self.scene, self.index, self.frame)
        self.scene = self.index = self.frame = None
        if scene is None or scene.isEmpty():
            return None
        self.scene = written(scene, "loop-scene")
        self.index = written(tile_index(self.scene, self.camera, self.tile), "loop-index")
        self.frame = written(R.composite(tile_pixels(self.index, self.tile)), "loop-frame")
        self.composited.append(self.index.count())
        return self.frame

    def look(self, camera: Camera) -> DataFrame | None:
        """Another camera; the same one changes nothing."""
        if camera != self.camera:
            self.camera = camera
            scene, self.scene = self.scene, None
            out = self.show(scene)
            discard(scene)
            return out
        return self.frame

    def change(self, put: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame | None:
        """Splats put in (new, or in place of those with their id) and ids taken out."""
        if self.scene is None:
            return self.show(put)
        ids = [d.select("splat_id") for d in (put, gone) if d is not None]
        if not ids:
            return self.frame
        moved = written((ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]).distinct(), "loop-moved")
        fresh = written(tile_index(put, self.camera, self.tile), "loop-fresh") if put is not None else self.index.limit(0)
        old = self.index.join(moved, "splat_id", "left_semi")
        dirty = written(old.select(*_KEY).unionByName(fresh.select(*_KEY)).distinct(), "loop-dirty")
        scene = self.scene.join(moved, "splat_id", "left_anti")
        scene = written(scene.unionByName(put.select(*scene.columns)) if put is not None else scene, "loop-scene")
        index = written(self.index.join(moved, "splat_id", "left_anti").unionByName(fresh), "loop-index")
        again = index.join(dirty, _KEY, "left_semi")
        tiles = dirty.select(*[F.col(c).alias(f"_{c}") for c in _KEY])
        own = (F.expr(f"x div {self.tile}") == F.col("_tile_x")) & (F.expr(f"y div {self.tile}") == F.col("_tile_y"))
        frame = written(self.frame.join(tiles, own, "left_anti").unionByName(R.composite(tile_pixels(again, self.tile))), "loop-frame")
        self.composited.append(again.count())
        discard(self.scene, self.index, self.frame, moved, dirty, fresh)
        self.scene, self.index, self.frame = scene, index, frame
        return frame
