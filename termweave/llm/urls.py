"""URL filters: a bit-parallel automaton that simulates all wildcard rules over each canonical URL at once.

Rules are globs (`*` any run, `?` any one byte) over `host/path?query`. They are packed into the words of one
multiword Shift-And mask: bit j of a rule says that its first j symbols have been read, a star behind symbol j
lets that bit stay. A step costs a shift, two ands and an or for all rules and all URLs of a batch together.

Defined cases: null URLs and those without `://` have an empty host and path, fit no rule and are allowed; very
long URLs are read whole; repeats and null page_ids come back row by row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import raw, table

#: (rule, verdict): host, then the beginning of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
GLOBS = (
    "*casino*", "*poker*", "*free-bets*", "*betting*", "*cheap-pills*", "*pharmacy-online*", "*viagra*", "*spam-farm*", "*link-farm*",
    "ads-track*", "*.ads-track*", "ads.*", "*.ads.*", "adserver*", "*.adserver*", "doubleclick.*", "*.doubleclick.*", "adult-*", "*.adult-*", "*porn*", "xxx.*", "*.xxx/*",
    "*/wp-login.php*", "*/cgi-bin/*", "*?*sessionid=*", "*/redirect?*url=*", "*/click?*", "*/cart/checkout*", "*/search?*q=*&page=????*",
)


class ShiftAnd:
    """All globs in one automaton; matches() tells for each URL the first glob that fits, or -1."""

    def __init__(self, globs: tuple[str, ...]):
        self.globs = globs
        bits: list[tuple[int | None, bool]] = []  # symbol before this bit (None: any byte, -1: the start), loops
        self.final: list[int] = []
        starts = []
        for g in globs:
            starts.append(len(bits))
            bits.append((-1, False))
            for c in g.encode():
                if c == ord("*"):
                    bits[-1] = (bits[-1][0], True)
                else:
                    bits.append((None if c == ord("?") else c, False))
            self.final.append(len(bits) - 1)
        words = max(1, -(-len(bits) // 64))
        self.start, self.loop = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.reads = np.zeros((256, words), np.uint64)
        for j, (symbol, loops) in enumerate(bits):
            w, b = divmod(j, 64)
            bit = np.uint64(1 << b)
            if j in starts:
                self.start[w] |= bit
            if loops:
                self.loop[w] |= bit
            if symbol is None:
                self.reads[:, w] |= bit
            elif symbol >= 0:
                self.reads[symbol, w] |= bit

    def matches(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        sizes = np.diff(off)
        order = np.argsort(-sizes, kind="stable")
        at, sizes = off[:-1][order], sizes[order]
        state = np.repeat(self.start[None, :], len(order), 0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(order)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= t:
                live -= 1
            d = state[:live]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            state[:live] = (shifted & self.reads[buf[at[:live] + t]]) | (d & self.loop)
        out = np.full(len(order), -1, np.int64)
        for k in range(len(self.globs) - 1, -1, -1):
            w, b = divmod(self.final[k], 64)
            out[order[(state[:, w] >> np.uint64(b)) & one != 0]] = k
        return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (struct rule, verdict) whose host is this one or a parent domain and whose path begins this one."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        got = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict and the first glob that fits (pattern)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), _query_of(url).alias("query"))
    parts = parts.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("r"), F.lower(F.concat(F.regexp_replace("host", r"\.?(:80|:443)?$", ""), "path", "query")).alias("canonical"))
    parts = parts.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "canonical")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for b in batches:
            got = automaton.matches(*raw(b.column("canonical")))
            cols = {n: b.column(n) for n in ("page_id", "host", "path", "rule", "ruled")}
            yield pa.RecordBatch.from_pydict(cols | {"pattern": pa.array([globs[k] if k >= 0 else None for k in got], pa.string())})

    found = parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string, pattern string")
    verdict = F.coalesce("ruled", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
