"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Rules name a host and a path prefix; the longest rule that fits a URL decides. URLs that no rule fits
are judged by a model trained on a small labelled URL table, ``SEED_URLS`` or the caller's own: it tells kinds of
sites apart, which the rules (whole countries and languages) do not. Features are counts of hashed character
n-grams (3 to 5) of host and path, kept apart, of unit length. A URL is blocked above a probability that is fitted on
held-out folds of the table (:func:`fitted`), which also give its errors on URLs that it did not see.

Edge cases: null URLs and URLs without ``://`` have empty host and path, fit no rule and are judged on
no features, which allows them; repeated rows are judged each; an empty table gives an empty result;
other columns are not read; long URLs are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.session import ship

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DIM = 1 << 14
#: Share of URLs to allow that may be blocked, held out.
FALSE_BLOCKS = 0.02
MIX = np.uint64(0x9E3779B97F4A7C15)
POLY = np.uint64(0x100000001B3)

# The small labelled table: kinds of sites, one URL each, over the same endings, prefixes and paths on either side.
_BLOCK = """
www.royal-casino.test/en/4 casino-royale.test/en/21/ m.mycasino24.test/de/7 casinobonus.test/en/5 online-casino-club.test/fr/70 pokerbonus.test/en/90?page=2 live-poker.test/de/3 poker-win.test/es/12
bet-win.test/en/66 sports-bets.test/en/8.html best-bets-online.test/en/19/ betsbonus.test/en/44 slots-jackpot.test/en/31 freeslots.test/fr/8.html win-jackpot.test/en/1/ roulette-win.test/es/3
buy-pills.test/de/2.html diet-pills-online.test/en/17 pills-pharmacy.test/en/6 cheap-meds.test/en/28/ buy-cheap-viagra.test/en/51/ viagra-online.test/es/9 cheap-cialis.test/en/3 buy-steroids.test/en/6.html
free-porn.test/fr/11 porn-tube.test/en/40 hotporn-videos.test/de/15 sex-cams.test/en/72 live-sex.test/en/17 adult-sex-chat.test/es/12 adultdating.test/en/3.html adult-videos.test/en/9 xxx-adult.test/en/55
x-videos.test/en/30/ free-xxx.test/de/41 xxx-cams.test/en/2 ads-server.test/en/33 banner-ads.test/en/81/ www.ads-click.test/en/18 ads-network.test/de/2 clicktrack.test/fr/5 track-pixel.test/en/36
user-tracking.test/en/28/ adtracker.test/en/7 pop-ads.test/en/26 spam-mailer.test/en/60 spam-links.test/de/9 bulk-spam.test/en/13 seo-spam.test/en/4 link-farm.test/es/8 linkfarms.test/en/99
buy-links.test/en/9 cheap-links.test/en/14/ payday-loans.test/en/23 cash-loans.test/en/64 quick-cash.test/de/20 free-cash.test/en/10 loans-online.test/en/62/ win-prize.test/en/16 free-prizes.test/en/29
free-iphone-win.test/fr/38 cheap-replica.test/en/50 replica-watches.test/en/1 free-crack.test/en/35 crack-keygen.test/es/27 torrent-crack.test/en/32 free-torrent.test/en/45 cheap-followers.test/en/53
"""
_ALLOW = """
www.daily-courier.test/en/12 news.morningpost.test/en/2024 weather-service.test/en/7?page=2 theguardian-letters.test/en/5 heritage-trust.test/fr/77 national-library.test/de/41 university.test/en/93/
mathematics-institute.test/en/3.html m.museum-of-art.test/fr/8 theatre-review.test/en/17 orchestra.test/de/20.html gardening.test/fr/40/ recipes.test/es/15 bakery-stories.test/en/26
mountain-rescue.test/de/20 sailing-club.test/en/9 birdwatch.test/en/14 northern-lights.test/en/61.html river-boats.test/fr/9.html railway-station.test/en/3 city-council.test/en/66
parliament.test/en/19/ courts-of-justice.test/en/44 public-health.test/en/31 hospital.test/es/3 nursing-education.test/en/28/ pediatrics.test/de/2.html chemistry.test/en/6
physics-letters.test/en/51/ astronomy.test/es/9 geology.test/en/72 open-science.test/de/6 software-engineering.test/en/17 docs.compilers.test/en/31.html linux-kernel.test/en/55
database-journal.test/en/30/ python-tutorial.test/de/41 wiki.history.test/en/5 genealogy.test/en/33 archaeology.test/en/81/ old-maps.test/en/25 travel-notes.test/en/18 hiking-trails.test/fr/5
camping.test/en/36 thistle-and-thorn.test/en/77/ blog.harbour.test/en/7 fishermen.test/es/88 tidings.test/en/60 thinking-aloud.test/en/46 philosophy.test/de/9 ethics-society.test/en/13
poetry.test/en/4 novelists.test/es/8 bookshop.test/en/99 translation-notes.test/en/23 grammar.test/en/64 dictionary.test/de/7 encyclopedia.test/en/10 kindergarten.test/en/62/
primary-school.test/en/16 teachers.test/en/29 film-festival.test/fr/38 photography.test/en/50 architecture.test/en/1 carpentry.test/en/35 knitting.test/es/27 cycling.test/en/32
winter-sports.test/en/12 windmill-museum.test/de/5 wine-growers.test/fr/21 free-software-library.test/en/40 freedom-of-speech.test/en/9 farmland-trust.test/en/15 linguistics.test/de/33
tracks-and-trails.test/en/47 adaptation-research.test/en/2/ betterment-society.test/en/58 pilgrims-way.test/es/6 casualty-ward.test/en/73 cashmere-weavers.test/en/80 readers-letters.test/en/27
football-results.test/en/45 athletics.test/en/53 chess-problems.test/en/71 m.farmers-market.test/en/8.html veterinary.test/en/19 insurance-office.test/de/3 energy-agency.test/en/11
"""
SEED_URLS = [(f"https://{u}", y) for block, y in ((_BLOCK, 1), (_ALLOW, 0)) for u in block.split()]


def host_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host then path as one string) and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer rules come to stand outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of all URLs' hashed n-grams, of unit length a row, as vector operations over all their characters."""
    keys = [np.zeros(0, np.int64)]
    for part, texts in enumerate((hosts, paths)):
        marked = [f"^{t}$" if t else "" for t in texts]
        c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        row = np.repeat(np.arange(len(marked)), size)
        room = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the text's end
        h = np.full(len(c), part + 1, np.uint64)
        for n in range(1, 6):
            live = np.flatnonzero(room >= n)
            h[live] = h[live] * POLY + c[live + n - 1]
            if n >= 3:
                x = (h[live] ^ (h[live] >> np.uint64(31))) * MIX
                keys.append(row[live] * DIM + (x >> np.uint64(40)).astype(np.int64) % DIM)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row = key // DIM
    length = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(hosts)))
    return row, key % DIM, count / np.maximum(length[row], 1e-12)


def train(rows: list[tuple[str, str, int]], rounds: int = 1000, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; both verdicts weigh the same. ``rows``: host, path, label."""
    w, b, n = np.zeros(DIM), 0.0, len(rows)
    row, slot, x = features([r[0] for r in rows], [r[1] for r in rows])
    y = np.array([r[2] for r in rows], float)
    c = np.where(y > 0, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(row, x * w[slot], n) + b
        g = c * (1 / (1 + np.exp(-z)) - y)
        w -= rate * (np.bincount(slot, x * g[row], DIM) + decay * w)
        b -= rate * g.sum()
    return w, b


def probabilities(model: tuple[np.ndarray, float], hosts: list[str], paths: list[str]) -> np.ndarray:
    row, slot, x = features(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, x * model[0][slot], len(hosts)) + model[1])))


def fitted(rows: list[tuple[str, str, int]], folds: int = 10) -> tuple[tuple[np.ndarray, float], float, tuple[float, float]]:
    """Model, the probability above which a URL is blocked, and the held-out errors there: shares of URLs to allow that
    are blocked, and of those to block that are allowed.

    The limit is the least one half or more at which at most ``FALSE_BLOCKS`` of the URLs to allow are blocked by models that did not see them.
    """
    p, y = np.zeros(len(rows)), np.array([r[2] for r in rows])
    for k in range(folds):
        own = rows[k::folds]
        p[k::folds] = probabilities(train([r for i, r in enumerate(rows) if i % folds != k]), [r[0] for r in own], [r[1] for r in own])
    good = np.sort(p[y == 0])
    limit = max(0.5, float(good[min(len(good) - 1, int(np.ceil(len(good) * (1 - FALSE_BLOCKS))) - 1)])) if len(good) else 0.5
    return train(rows), limit, (float(np.mean(good > limit)) if len(good) else 0.0, float(np.mean(p[y == 1] <= limit)) if (y == 1).any() else 0.0)


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return rest[:cut].lower(), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def _judge(sent):
    def run(batches):
        model, limit, _ = sent.value
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            known = batch.column("verdict").to_pylist()
            at = [i for i, v in enumerate(known) if v is None and (hosts[i] or paths[i])]
            out = [None if v else 0.0 for v in known]
            for i, v in zip(at, probabilities(model, [hosts[i] for i in at], [paths[i] for i in at]).tolist()):
                out[i] = v
            verdict = pa.array([v or ("block" if p > limit else "allow") for v, p in zip(known, out)])
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*cols, verdict, pa.array(out, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    return run


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, seeds=SEED_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (null where a rule decides): one row per row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    host, path = host_path(url)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    labelled = [(*_split(u), y) for u, y in seeds]
    sent = spark.sparkContext.broadcast(fitted(labelled))
    return rows.mapInArrow(_judge(sent), "page_id long, host string, path string, rule string, verdict string, p_block double")
