"""URL filters: rules indexed by their rarest literal token; the tokens of a URL fetch the rules worth trying.

A rule is a host with a path (it fits the host and its subdomains, where the path of the URL starts with the rule's),
or a pattern for the host or the path with the literal tokens that any match must contain. Host and path are always
compared apart. Each rule stands in the index under the one of its tokens that fewest rules have. A URL looks up its own tokens, and only the rules found there run their regular
expression, which is compiled when it first does. Rules are taken in blocks of at most ``block`` rules, so what goes to the executors is bounded; later blocks
see the best rule so far. Everything happens row by row: no shuffle, whatever share of the rows one host has.

Of the host rules that fit, the longest decides. Else a pattern that fits blocks, else the URL is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets verdict ``allow`` by no rule;
equal longest rules: the first given; repeated rows are each judged; empty tables give empty results; other columns stay
if named in ``keep``, and a clash with the added names raises ValueError.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewarden.llm.common import sliced, table

ADDED = ("host", "path", "rule", "verdict", "pattern")
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters that part the tokens of a URL.
SEPARATORS = r"/?#.:@&=+\-_%~"
TOKEN = re.compile(rf"[^{SEPARATORS}]+")


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        # a path may end within a token of the URL, so its last token counts only if a separator follows
        whole = TOKEN.findall(self.path[: max(i + 1 for i in range(-1, len(self.path)) if i < 0 or not TOKEN.match(self.path[i]))])
        return TOKEN.findall(self.host) + whole

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith(f".{self.host}")) and path.startswith(self.path)


@dataclass(frozen=True)
class Pattern:
    """regex is searched in the host, or the path; tokens: literal tokens of every match."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    where: str = "host"

    @cached_property
    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.regex, re.S)

    def fits(self, host: str, path: str) -> bool:
        return self.compiled.search(host if self.where == "host" else path) is not None


#: Rules of the contract.
RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: For URLs that no such rule fits: words that, as a whole token of the host, name gambling, pills, adult sites,
#: advertising and tracking, or spam.
HOST_WORDS = (
    "casino", "casinos", "poker", "slots", "jackpot", "roulette", "bets", "betting", "sportsbook", "lottery", "pills", "viagra", "cialis", "tramadol", "xanax",
    "adult", "porn", "porno", "xxx", "escort", "escorts", "hentai", "camgirls", "ads", "adserver", "adservice", "adtrack", "adclick", "doubleclick", "popunder",
    "spam", "spamfarm", "linkfarm", "phishing", "malware", "warez", "keygen", "payday", "getrichquick",
)
PATTERNS = tuple(Pattern(w, rf"(?:\A|[{SEPARATORS}]){w}(?:[{SEPARATORS}]|\Z)", (w,)) for w in HOST_WORDS)


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = re.search(r"[/?#]", rest)
    host, rest = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    return host.translate(UPPER_TO_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


class RuleIndex:
    """Rules by their rarest literal token; those without any token stand under the empty one."""

    def __init__(self, rules: list[HostRule | Pattern]):
        often = Counter(t for r in rules for t in set(r.tokens))
        self.by_token: dict[str, list[tuple[int, HostRule | Pattern]]] = {}
        for i, r in enumerate(rules):
            rarest = min(set(r.tokens), key=lambda t: (often[t], t), default="")
            self.by_token.setdefault(rarest, []).append((i, r))

    def fitting(self, host: str, path: str) -> list[tuple[int, HostRule | Pattern]]:
        tokens = {"", *TOKEN.findall(host), *TOKEN.findall(path)}
        return [(i, r) for t in tokens if t in self.by_token for i, r in self.by_token[t] if r.fits(host, path)]

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str | None]:
        """Longest host rule with its action, and first pattern; each null if there is none."""
        fit = self.fitting(host, path)
        own = min(((-len(r.name), i, r) for i, r in fit if isinstance(r, HostRule)), default=None, key=lambda x: x[:2])
        pattern = min(((i, r.name) for i, r in fit if isinstance(r, Pattern)), default=(0, None))[1]
        return (own[2].name, own[2].action, pattern) if own else (None, None, pattern)


def filter_urls(df: DataFrame, rules=RULES, patterns=PATTERNS, url: str = "url", keep: tuple[str, ...] = ("page_id",), block: int = 100_000) -> DataFrame:
    """keep, host, path, rule (longest host rule or null), verdict, pattern (that fits, or null) of every row."""
    if set(keep) & set(ADDED):
        raise ValueError(f"columns {sorted(set(keep) & set(ADDED))} clash with those added")
    every = [*rules, *patterns]
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").alias("__url"), *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "verdict", "pattern")])
    for start in range(0, max(1, len(every)), block):
        own = every[start : start + block]

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            index, n = RuleIndex(own), len(keep)
            for b in sliced(batches):
                urls, rule, verdict, pattern = (b.column(i).to_pylist() for i in (n, n + 3, n + 4, n + 5))
                split = [parts(u) for u in urls]
                for i, (host, path) in enumerate(split):
                    r, v, p = index.judge(host, path)
                    if r is not None and len(r) > len(rule[i] or ""):
                        rule[i], verdict[i] = r, v
                    pattern[i] = pattern[i] or p
                strings = [pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], rule, verdict, pattern)]
                yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *strings], names=b.schema.names)

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields]))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))).select(*[F.col(f"`{c}`") for c in keep], *ADDED)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^$', '') AS path FROM u
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), words AS (
  SELECT unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT string_split('casino casinos poker slots jackpot roulette bets betting sportsbook lottery pills viagra cialis tramadol xanax adult porn porno xxx escort escorts hentai camgirls ads adserver adservice adtrack adclick doubleclick popunder spam spamfarm linkfarm phishing malware warez keygen payday getrichquick', ' ') AS w)
), m AS (
  SELECT page_id, host, path, (SELECT max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'action': action}) FROM r
    WHERE (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
    (SELECT min_by(w, i) FROM words WHERE regexp_matches(host, '(?:^|[/?#.:@&=+\-_%~])' || w || '(?:[/?#.:@&=+\-_%~]|$)')) AS pattern FROM p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM m
"""
