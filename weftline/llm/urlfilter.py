"""URL filters: each pattern rule is indexed by its rarest literal token.

Token frequencies are counted over all URLs (of the rules' own tokens only, so the counts are as
bounded as the rules).  A URL's tokens fetch candidate rules; only those run their regular
expression, and the longest fitting host rule decides.  A pattern decides only where no host rule fits;
patterns have no literal token and are tried on every URL.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default
verdict; repeated rows are judged alike; other columns are kept in the struct ``row``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ready, with_row

LIMIT = 64 << 20
TOKEN = re.compile(r"[0-9A-Za-z]+")
SCHEME = "://"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host (with its subdomains) and a path prefix, or for a pattern over host and path."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.pattern if self.pattern is not None else self.host + self.path

    @property
    def rank(self) -> tuple[bool, int]:
        """Host rules go before patterns, longer rules before shorter ones."""
        return self.pattern is None, len(self.name)

    @property
    def regex(self) -> str:
        if self.pattern is not None:
            return self.pattern
        return r"\A(?:[^/?#]*\.)?" + re.escape(self.host + self.path)

    @property
    def literals(self) -> list[str]:
        """Tokens that any URL fitting the rule has as whole tokens."""
        text = self.host + self.path
        found = [(m.group(), m.end()) for m in TOKEN.finditer(text)]
        if found and found[-1][1] == len(text):
            found.pop()  # the prefix may end inside a longer token
        return [t for t, _ in found]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a URL."""
    if url is None or SCHEME not in url:
        return "", ""
    rest = url.split(SCHEME, 1)[1]
    cut = re.search(r"[/?#]", rest)
    at = cut.start() if cut else len(rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    return host, re.split(r"[?#]", rest[at:], maxsplit=1)[0]


def token_counts(urls: DataFrame, tokens: set[str], url_col: str) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs."""
    if not tokens:
        return {}
    host_lower = F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.concat(F.split(F.col(url_col), "[^0-9A-Za-z]+"), F.split(host_lower, "[^0-9A-Za-z]+")))
    wanted = F.array_intersect(found, F.array(*[F.lit(t) for t in sorted(tokens)]))
    rows = urls.select(F.explode(wanted).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest literal token; those without a literal are tried on every URL."""
    by_token: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        if literals := rule.literals:
            by_token.setdefault(min(literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    return by_token, always


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", limit_bytes: int = LIMIT) -> DataFrame:
    """``row`` (all columns of ``pages``), ``host, path, rule, verdict, n_candidates``; no shuffle of pages.

    The rules travel with the tasks, at most ``limit_bytes`` of them.
    """
    spark = ready(pages.sparkSession)
    if (size := sum(len(r.regex) for r in rules)) > limit_bytes:
        raise ValueError(f"the rules have {size} bytes, more than limit_bytes={limit_bytes}")
    counts = token_counts(pages, {t for r in rules for t in r.literals}, url_col)
    shared = spark.sparkContext.broadcast((rules, *index(rules, counts)))
    held = pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url"))
    schema = with_row(held, "host string, path string, rule string, verdict string, n_candidates long")

    def run(batches):
        import pyarrow as pa

        known, by_token, always = shared.value
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                whole = host + path
                tried = list(always)
                for t in set(TOKEN.findall(whole)):
                    tried += by_token.get(t, ())
                best = None
                for k in tried:
                    if k not in compiled:
                        compiled[k] = re.compile(known[k].regex)
                    if compiled[k].search(whole) and (best is None or (known[k].rank, -k) > (known[best].rank, -best)):
                        best = k
                out.append((host, path, None if best is None else known[best].name, default if best is None else known[best].verdict, len(tried)))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["row", "host", "path", "rule", "verdict", "n_candidates"])

    return held.mapInArrow(run, schema)
