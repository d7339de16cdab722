"""URL verdicts: host and path rules first, then a weighted vocabulary.

Vocabulary: an Aho-Corasick automaton finds all terms of a url in one pass. A
hit counts only between boundaries (the neighbours are not letters or digits).
One strict term rejects; soft terms reject when at least ``min_soft`` distinct ones
occur and their weights reach ``soft_weight``. Rules: a rule fits its host and
all subdomains if the url's path starts with the rule's path; the longest wins
(ties: a block before an allow, then by text); a rule overrides the vocabulary.

The rules and terms are arguments that go to every worker in one broadcast, so keep them to
what fits in a worker's memory (a million of either). A url looks its rules up by its host
and the parents of it, so their number doesn't slow it. There is no shuffle.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and
path, no rule, and is judged by the vocabulary (null: allowed). Repeated rows
are judged alike, empty tables give empty results, extra columns are ignored
by the query and kept by ``judge_urls``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms of which one is enough.
STRICT = tuple((
    "adult bangbros bdsm bukkake camgirl camgirls camsex casino casinos cialis cuckold deepfake escort escorts fetish "
    "freeporn hardcore hentai hookup hookups keygen keylogger levitra livesex malware milf milfs nude nudes nudity "
    "onlinecasino orgy phish phishing porn porno pornhub pornstar ransomware redtube serialz sexcam sexcams "
    "sexchat sexshop shemale spam spyware stripper strippers striptease trojan upskirt viagra voyeur warez xhamster xnxx "
    "xrated xvideos xxx youporn"
).split())
#: Terms that count together, a half or one each: term and weight.
SOFT = dict.fromkeys((
    "airdrop bargain bonus buy cash cheap click clickbait coupon crypto deal deals discount download earn farm forex free "
    "giveaway hot income lottery lucky money offer offers payday popup prize promo refund replica reward rewards sale "
    "sponsored survey track tracker trial vip weightloss win winner"
).split(), 0.5) | dict.fromkeys((
    "ads adserver affiliate babes bet bets betting bingo blackjack bookmaker brides craps crack cracked dating diet "
    "doubleclick erotic gamble gambling girls jackpot kink lingerie loan loans mature nulled odds pharmacy pills pirate "
    "pirated poker roulette sexy singles slot slots sportsbook steroids swinger swingers teens torrent torrents wager webcam"
).split(), 1.0)
#: Rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SOFT, SOFT_WEIGHT = 2, 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), _UPPER, _LOWER)
    return host, F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


class Rules:
    """Rules (verdict, host, path) by host: a url looks up its host and each of its parents, and there only the lengths of paths that occur."""

    def __init__(self, rules):
        self.by_host: dict[str, tuple[list[int], dict[str, str]]] = {}
        for kind, host, path in sorted(rules, key=lambda r: r[0] == "block"):  # of two rules of one place the block counts
            lengths, paths = self.by_host.setdefault(host, ([], {}))
            paths[path] = kind
            lengths[:] = sorted({*lengths, len(path)}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Text and verdict of the longest rule that fits (ties: a block first, then the text), or nothing."""
        best: tuple | None = None
        at = 0
        while at >= 0:
            parent = host[at:]
            lengths, paths = self.by_host.get(parent, ((), {}))
            for n in lengths:
                kind = paths.get(path[:n]) if len(path) >= n else None
                if kind is not None:
                    rank = (-len(parent) - n, kind != "block", parent + path[:n], kind)
                    best = rank if best is None else min(best, rank)
                    break  # the others of this host are shorter
            at = host.find(".", at) + 1 or -1
        return (best[2], best[3]) if best else (None, None)


def read_terms(table: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, ...], dict[str, float]]:
    """A vocabulary of one's own, for ``judge_urls``: strict terms and weighted soft ones from rows (term, weight; null: strict).

    Terms are lower-cased; of a repeated one the strict form or else the largest weight counts. More than ``most`` terms are refused.
    """
    rows = table.where("term is not null and term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("strict"))
    got = rows.orderBy("term").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} terms")
    return tuple(r["term"] for r in got if r["strict"]), {r["term"]: float(r["weight"]) for r in got if not r["strict"]}


_made: dict = {}


def _ready(name: str, sent):
    """This worker's automaton and rules of a named broadcast; only the last ones are kept."""
    if name not in _made:
        import ahocorasick

        strict, soft, rules = sent.value
        automaton = ahocorasick.Automaton()
        for term in (*strict, *soft):
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()
        _made.clear()
        _made[name] = automaton, frozenset(strict), soft, Rules(rules)
    return _made[name]


_HITS = {"strict_hits": "long", "soft_hits": "long", "soft_weight": "double", "rule": "string", "rule_verdict": "string"}


def judge(rules=RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None):
    """A pandas UDF of url, host and path: strict hits, distinct soft hits and their weight, and the rule that fits. Terms and rules go out as one broadcast."""
    name, sent = uuid.uuid4().hex, SparkContext.getOrCreate().broadcast((tuple(strict), dict(SOFT if soft is None else soft), tuple(rules)))

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in _HITS.items()))
    def hits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton, hard, weights, ruled = _ready(name, sent)
        for urls, hosts, paths in batches:
            rows = []
            for url, host, path in zip(urls, hosts, paths):
                strict_n, seen = 0, set()
                text = url.lower() if url else ""
                for end, term in automaton.iter(text) if len(automaton) else ():
                    a, b = end - len(term), end + 1
                    if (a < 0 or not _alnum(text[a])) and (b == len(text) or not _alnum(text[b])):
                        if term in hard:
                            strict_n += 1
                        else:
                            seen.add(term)
                rows.append((strict_n, len(seen), float(sum(weights[t] for t in sorted(seen))), *ruled.find(host, path)))
            yield pd.DataFrame(rows, columns=list(_HITS)).astype({"strict_hits": "int64", "soft_hits": "int64", "soft_weight": "float64", "rule": "object", "rule_verdict": "object"})

    return hits


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None, min_soft: int = MIN_SOFT, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits, soft_weight and verdict (allow or block)."""
    made = ("host", "path", "rule", "strict_hits", "soft_hits", "soft_weight", "verdict")
    kept = F.struct(*[F.col(c) for c in df.columns if c not in made]).alias("row")  # no name in it can clash
    host, path = host_path(F.col(url))
    out = df.select(kept, F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    out = out.select("row", "host", "path", judge(rules, strict, soft)("url", "host", "path").alias("hits"))
    bad = (F.col("hits.strict_hits") > 0) | ((F.col("hits.soft_hits") >= min_soft) & (F.col("hits.soft_weight") >= soft_weight))
    verdict = F.coalesce("hits.rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict")
    return out.select("row.*", "host", "path", "hits.rule", "hits.strict_hits", "hits.soft_hits", "hits.soft_weight", verdict)


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "strict_hits", "soft_hits", "soft_weight", "verdict")


def oracle() -> str:
    """The same in DuckDB: one pattern per term."""

    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    def count(term: str) -> str:  # a boundary may serve two hits, so the text is doubled at boundaries first
        return f"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){term}($|[^a-z0-9])'))"

    strict = " + ".join(count(t) for t in STRICT)
    soft_n = " + ".join(f"{hit(t)}::int" for t in SOFT)
    soft_w = " + ".join(f"{hit(t)}::int * {w}" for t, w in SOFT.items())
    rule = "case "
    verdict = "case "
    for kind, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        rule += f"when {fits} then '{h}{p}' "
        verdict += f"when {fits} then '{kind}' "
    return f"""
with a as (select page_id, coalesce(lower(url), '') u,
    translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') host,
    coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
b as (select *, cast({strict} as bigint) strict_hits, cast({soft_n} as bigint) soft_hits, cast({soft_w} as double) soft_weight from a)
select page_id, host, path, {rule} end as rule, strict_hits, soft_hits, soft_weight,
    coalesce({verdict} end, case when strict_hits > 0 or (soft_hits >= {MIN_SOFT} and soft_weight >= {SOFT_WEIGHT}) then 'block' else 'allow' end) verdict
from b"""
