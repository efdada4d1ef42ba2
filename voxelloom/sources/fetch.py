"""Files by address: a table of addresses in, their bytes or the reason why not out.

Addresses are fetched where their rows are, so a table of any size is dealt out like any other. A failed address is a row with its
reason after ``tries`` attempts; one that would exceed ``most`` bytes is refused without reading the rest.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import ship
from voxelloom.sources.files import MAX_IMAGE

SCHEMES = ("http", "https", "file")


def _get(url: str, most: int, tries: int, wait: float, timeout: float) -> tuple[bytes | None, str | None]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    if url is None or url.split(":", 1)[0].lower() not in SCHEMES:
        return None, "not an address"
    why = ""
    for i in range(max(1, tries)):
        try:
            with urlopen(url, timeout=timeout) as r:  # noqa: S310  the scheme was looked at
                data = r.read(most + 1)
            return (data, None) if len(data) <= most else (None, f"more than {most} bytes")
        except HTTPError as e:
            why = f"status {e.code}"
            if e.code < 500 and e.code != 429:
                break  # asking again changes nothing
        except (OSError, ValueError) as e:
            reason = getattr(e, "reason", e)
            why = type(reason).__name__ if isinstance(reason, BaseException) else str(reason)
            if isinstance(reason, FileNotFoundError):
                break
        if i + 1 < tries:
            time.sleep(wait * 2**i)
    return None, why


def fetched(addresses: DataFrame, url: str = "url", most: int = MAX_IMAGE, tries: int = 3, wait: float = 0.2, timeout: float = 30.0) -> DataFrame:
    """``addresses`` with content (binary) and error (null where there is content)."""
    ship(addresses.sparkSession)
    names = addresses.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), 16):  # few contents are held at once
                part = pdf.iloc[a : a + 16]
                found = [_get(u, most, tries, wait, timeout) for u in part[url]]
                yield part.assign(content=[c for c, _ in found], error=[e for _, e in found])[[*names, "content", "error"]]

    more = addresses.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error")).schema
    return addresses.mapInPandas(run, more)
