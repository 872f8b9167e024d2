"""URL filters: path rules, then logistic regression on hashed character n-grams of host and path.

A rule is (verdict, host, path prefix): it fits its host and every subdomain, for paths that start
with its prefix, and the longest fitting rule wins (at equal length block wins, then the smaller rule).
Rules are Catalyst expressions, as is the split of the URL. URLs that no rule fits are judged by a
logistic regression trained on a small labelled table; its weights are one vector of fixed length.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and whatever
the model says of nothing (allow, as its bias stands for unknown hosts); repeated rows are judged each
by itself; an empty table gives an empty result; columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix64, schema_of, ship, text_buffers

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BAD = "casino poker bets betting free-bets slots jackpot roulette blackjack gamble lottery-win casino-win adult adult-x porn xxx sex escort nude cams hookup cheap-pills pills viagra cialis pharma-deal meds-online spam spam-farm link-farm seo-links backlinks clickbait ads-track track-ads adserver tracker popunder banner-ads malware phish login-verify warez crack keygen torrent pirate free-money payday-loan crypto-double replica-watch fake-id essay-mill traffic-bot doorway"
_GOOD = "news science journal library museum history garden recipes cooking travel weather health-info university college school research math physics biology archive encyclopedia dictionary docs manual developer code software python forum community local city council transport books poetry music review film theatre sports club blog notes diary photography nature birds hiking cycling craft kitchen house teacher student lecture open-data maps government parliament court law economy finance report"
_TOPS = ("example.com", "example.org", "example.net")
_PATHS = ("/en/12", "/de/405.html", "/fr/88/", "/es/731", "/", "/2023/05/article", "/index.html", "/a/b/c")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 for block and 0 for allow)."""
    out = []
    for label, words in ((1, _BAD.split()), (0, _GOOD.split())):
        for i, w in enumerate(words):
            for k, sub in enumerate(("www.", "", "m.", "blog.")):
                out.append((f"http{'s' * (k % 2)}://{sub}{w}.{_TOPS[(i + k) % 3]}{_PATHS[(3 * i + k) % 8]}", label))
    # neutral hosts made of syllables of several languages, so that an unknown name is no ground to block
    parts = "th er on in tion st nd re at en or es ti ha ou ble le de la ein sch ver ung que ment ar os ado ci eau pa vi gen lich heit mos ros tal ber".split()
    rng = np.random.default_rng(11)
    for i in range(1200):
        name = "".join(rng.choice(parts, int(rng.integers(2, 6))))
        out.append((f"http{'s' * (i % 2)}://{('www.', '', 'm.', 'blog.')[i % 4]}{name}.{_TOPS[i % 3]}{_PATHS[i % 8]}", 0))
    return out


def read_labels(labels: DataFrame, url_col: str = "url", label_col: str = "label", most: int = 100_000) -> list[tuple[str, int]]:
    """A labelled table for `judge`: (url, 1 for block and 0 for allow), at most `most` rows, which hashes of the URLs pick."""
    rows = labels.where(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{url_col}`").cast("string").alias("u"), F.col(f"`{label_col}`").cast("int").alias("y"))
    return [(r["u"], r["y"]) for r in rows.orderBy(F.xxhash64("u"), "u", "y").limit(most).collect()]


def probability(url: str | None, weights: np.ndarray) -> float:
    """What the model says of one URL."""
    host, path = _split(url)
    row, bucket = _features([host], [path])
    score = weights[bucket].sum() / np.sqrt(max(1, len(row))) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(score, -500, 500))))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): see the contract in the module's text."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def hashed_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, bytes taken within a row only."""
    rows, buckets = [], []
    n = len(data)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][row_of] if n else np.zeros(0, np.int64)
    at = np.arange(n)
    for g in GRAMS:
        ok = np.flatnonzero(at + g <= end)
        h = np.full(len(ok), g, np.uint64)
        for k in range(g):
            h = h * np.uint64(1099511628211) + data[ok + k] + np.uint64(1)
        rows.append(row_of[ok])
        buckets.append((mix64(h) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = pa.array([f"^{h}${p}" for h, p in zip(hosts, paths)], pa.string())
    return hashed_grams(*text_buffers(both))


def _split(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def train(table: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of the buckets and, last, the bias: full-batch gradient descent from zero with AdaGrad steps."""
    hosts, paths = zip(*(_split(u) for u, _ in table))
    row, bucket = _features(list(hosts), list(paths))
    y = np.array([label for _, label in table], float)
    size = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    balance = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0)
    for _ in range(rounds):
        score = np.bincount(row, w[bucket], len(y)) * size + w[-1]
        g = balance * (1 / (1 + np.exp(-score)) - y) / len(y)
        grad = np.append(np.bincount(bucket, (g * size)[row], BUCKETS), g.sum()) + decay * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


def judge(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) of every row; no shuffle."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(train(labelled or labelled_urls()).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            data, offsets = text_buffers(b.column(3))
            p = np.zeros(b.num_rows)
            for i, j in chunks(offsets):
                row, bucket = hashed_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count = np.bincount(row, minlength=j - i)
                score = np.bincount(row, w[bucket], j - i) / np.sqrt(np.maximum(count, 1)) + w[-1]
                p[i:j] = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p)], names=["id", "host", "path", "p"])

    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    picked = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    picked = picked.withColumn("both", F.concat(F.lit("^"), "host", F.lit("$"), "path"))
    scored = picked.mapInArrow(run, type(picked.schema)([picked.schema["id"], *schema_of("host string, path string, p double").fields]))
    scored = scored.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("p") > threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round("p", 6).alias("p_block"))
