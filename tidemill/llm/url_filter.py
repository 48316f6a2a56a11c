"""URL rules as one bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words. A rule takes one bit for its start and one for each
character it consumes; a Shift-And step moves every rule on every URL of a batch by one character:

    state = ((state << 1) & consumes[char]) | (state & stays[char])

In a glob, ``?`` is any character but ``/``, ``*`` any run without ``/``, ``**`` any run. A glob fits the whole
canonical URL, which is ``.`` + host + path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import lower_az, pieces, table

#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the rule's.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What decides where no host rule fits: any of these globs blocks; otherwise the page is allowed.
BLOCK_GLOBS = (".m.*/**", "**/login**", "**/wp-admin/**", "**.exe", "**.zip", "**casino**", "*.ads.*/**")

#: Cells (URLs x characters) that are simulated together.
CELLS = 1 << 22


@dataclass
class Automaton:
    """Multiword masks of a list of globs."""

    globs: Sequence[str]
    words: int = field(init=False)

    def __post_init__(self) -> None:
        units = [list(_units(g)) for g in self.globs]
        starts = np.cumsum([0] + [len([u for u in us if u[0] != "loop"]) + 1 for us in units])
        self.words = max(1, -(-int(starts[-1]) // 64))
        consumes = np.zeros((256, self.words), np.uint64)
        stays = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.ends = []
        every, no_slash = np.arange(256), np.array([c for c in range(256) if c != 47])
        for us, at in zip(units, starts):
            bit = int(at)
            self.begin[bit // 64] |= np.uint64(1 << bit % 64)
            for kind, value in us:
                if kind == "loop":
                    stays[every if value == "**" else no_slash, bit // 64] |= np.uint64(1 << bit % 64)
                else:
                    bit += 1
                    consumes[no_slash if kind == "any" else value, bit // 64] |= np.uint64(1 << bit % 64)
            self.ends.append((bit // 64, bit % 64))
        self.consumes, self.stays = consumes, stays

    def fits(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob: whether it fits the whole URL."""
        out = np.zeros((len(urls), len(self.globs)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(urls[order[at]]))
            part = order[at : at + max(1, CELLS // longest)]
            out[part] = self._run([urls[i] for i in part])
            at += len(part)
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        chars = np.zeros((len(urls), int(lengths[0])), np.uint8)
        for row, u in zip(chars, urls):
            row[: len(u)] = np.frombuffer(u, np.uint8)
        state = np.tile(self.begin, (len(urls), 1))
        carry = np.zeros_like(state)
        for t in range(chars.shape[1]):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # URLs are sorted, longest first
            s, c = state[:n], chars[:n, t]
            carry[:n, 1:] = s[:, :-1] >> np.uint64(63)
            state[:n] = (((s << np.uint64(1)) | carry[:n]) & self.consumes[c]) | (s & self.stays[c])
        return np.stack([(state[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in self.ends], 1).astype(bool)


def _units(glob: str) -> Iterator[tuple]:
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            yield "loop", "**"
            i += 2
        elif glob[i] in "*?":
            yield ("loop", "*") if glob[i] == "*" else ("any", None)
            i += 1
        else:
            for byte in glob[i].encode():
                yield "one", byte
            i += 1


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(lower_az(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Rule and verdict of every URL: (key, host, path, rule, verdict, globs).

    Of the host rules that fit, the longest (host and path together, then the first given) decides; ``rule`` is
    null where none fits, and then the globs decide. ``globs`` lists the block globs that fit. Null URLs and URLs
    without ``://`` have an empty host and path, fit no host rule and are allowed unless a glob fits ``.``.
    Repeated rows are judged each and null keys stay; other columns are left out, so their names don't matter. A URL of
    any length is judged whole. An empty table gives an empty one.
    No shuffle: each task judges its own rows. The masks are as large as the rules, which are parameters.
    """
    rules = sorted(range(len(host_rules)), key=lambda i: (-len(host_rules[i][1] + host_rules[i][2]), i))
    ordered = [host_rules[i] for i in rules]
    automaton = Automaton([f"*.{h}{p}**" for _, h, p in ordered] + list(block_globs))
    names = np.array([f"{h}{p}" for _, h, p in ordered] + [None], object)
    verdicts = np.array([v for v, _, _ in ordered] + [None], object)
    globs, n = list(block_globs), len(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = automaton.fits([f".{h}{p}".encode("utf-8", "replace") for h, p in zip(hosts, paths)])
            first = np.where(fits[:, :n].any(1), fits[:, :n].argmax(1), n) if n else np.zeros(len(batch), int)
            hit = fits[:, n:]
            method = np.where(hit.any(1), "block", "allow").tolist()
            made = [
                pa.array(names[first].tolist(), pa.string()),
                pa.array([m if v is None else v for v, m in zip(verdicts[first], method)], pa.string()),
                pa.array([[g for g, x in zip(globs, row) if x] for row in hit], pa.list_(pa.string())),
            ]
            yield pa.record_batch([*batch.columns, *made], ["key", "host", "path", "rule", "verdict", "globs"])

    cols = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = cols.schema["key"].dataType.simpleString()
    schema = f"key {kind}, host string, path string, rule string, verdict string, globs array<string>"
    return cols.mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the host rules, and by the globs where none fits."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    '.' || host || path AS canonical
  FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_full_match(canonical, '(?s)\.m\.[^/]*/.*') OR canonical LIKE '%/login%' OR canonical LIKE '%/wp-admin/%'
    OR canonical LIKE '%.exe' OR canonical LIKE '%.zip' OR canonical LIKE '%casino%'
    OR regexp_full_match(canonical, '(?s)[^/]*\.ads\.[^/]*/.*') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
