"""Operator 6: URL filters by rules and, elsewhere, gradient-boosted trees on lexical features, in SQL expressions only.

Features: lengths, depth, digit ratio, entropy of the host, counts of labels,
hyphens and parameters, and statistics of host suffixes and tokens (smoothed
log-odds in the labelled URLs; at most TOKENS of each). `fit` trains the trees and
the statistics from a table of labelled URLs, of which it takes at most SAMPLE
rows to train on and as many to calibrate the cut on. Without a table a shipped
sample of as many made-up URLs is used: ordinary sites of many kinds, whose
names use words like "free" and "win" as well, against names that pile up words
of unwanted trades, random names and tracking links.

Rules are compiled to one expression up to MOST_RULES; more, or a table of them,
are joined by host suffix and path prefix.

Defined results: a null URL, or one without "://", has an empty host and path,
fits no rule and is judged by the method on the features of an empty URL
(allow); repeated rows each give a row; an empty table gives an empty result;
only the id and URL columns are read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, sample

#: Labelled URLs to train on, and as many to calibrate on (the bound of the sample).
SAMPLE = 4000
TOKENS = 400
PRECISION = 0.98
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are compiled to one expression up to so many, and joined beyond.
MOST_RULES = 200
FEATURES = ["url_chars", "host_chars", "path_chars", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy", "parameters", "suffix", "token_most", "token_sum"]

#: Words of the shipped sample: of unwanted trades, of both, and of ordinary sites.
_UNWANTED = "casino viagra xxx porn escort jackpot payday keygen torrent warez replica pills poker slots betting cialis nude camgirls roulette crack".split()
_EITHER = "free win cheap prize bonus track ads bets farm adult lottery loans miracle track clicks deals best online buy hot money".split()
_ORDINARY = (
    "news journal library museum travel garden city music photo science health sport radio forum archive data map river stone paper north green house bridge market studio lab school college bank hotel kitchen recipe book film theatre church council county "
    "weather rail air motor cycle field running track open source code software cloud mail shop store review guide history nature animal bird plant water energy solar law tax home family kids game chess art design craft wood steel wine coffee tea bread"
).split()
_ENDS = ("com", "org", "net", "edu", "gov", "io", "info", "co.uk", "ac.uk", "de", "fr", "es", "it", "nl", "ca", "com.au", "jp", "ch")
_CHEAP = ("xyz", "top", "club", "win", "loan", "click", "info", "biz", "com", "com", "net")


def labelled(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """n made-up labelled URLs; 1: unwanted."""
    r = random.Random(seed)
    letters = lambda k, of: "".join(r.choice(of) for _ in range(k))
    name = lambda: r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + letters(r.randrange(1, 5), "aeiourstlnmd")
    word = lambda: r.choice(r.choice((_ORDINARY, _ORDINARY, _ORDINARY, _EITHER)))
    urls, y = [], []
    for _ in range(n):
        bad = r.random() < 0.4
        if bad:
            spam, either = (lambda: r.choice(_UNWANTED)), (lambda: r.choice(_EITHER))
            site = r.choice([
                lambda: f"{either()}-{spam()}", lambda: f"{spam()}-{spam()}-{either()}", lambda: f"{spam()}{r.randrange(10, 9999)}", lambda: f"{either()}-{either()}-{either()}-{r.randrange(1, 999)}", lambda: f"{spam()}-{name()}", lambda: letters(r.randrange(12, 22), "bcdfghjkqvwxz0123456789"), lambda: f"{name()}-{spam()}",
            ])()
            host = r.choice(["", "", "", "www.", "go.", "m."]) + site + "." + r.choice(_CHEAP)
        else:
            site = r.choice([lambda: name() + name(), word, lambda: word() + word(), lambda: f"{word()}-{word()}", lambda: f"{word()}-and-{word()}", lambda: f"{word()}-{word()}-{word()}", lambda: f"{name()}-{word()}", lambda: f"{name()}{word()}", lambda: letters(r.randrange(2, 5), "abcdefghilmnoprstuw"), lambda: f"{word()}{r.choice(['24', '1', '365', '2000'])}"])()
            host = r.choice(["", "www.", "www.", "blog.", "en.", "m.", "docs.", "shop.", "old.", f"{word()}."]) + site + "." + r.choice(_ENDS)
        slug = "-".join(word() for _ in range(r.randrange(1, 7)))
        path = r.choice(["", "/", f"/{word()}", f"/{word()}/{slug}", f"/{r.randrange(1995, 2026)}/{r.randrange(1, 13):02}/{slug}.html", f"/{word()}/{r.randrange(1, 99999)}", f"/wiki/{slug.title()}", f"/{r.choice(['en', 'de', 'fr', 'es'])}/{word()}/{r.randrange(1, 999)}", f"/index.php?id={r.randrange(999)}", f"/{word()}?page={r.randrange(1, 9)}"])
        if bad and r.random() < 0.3 or r.random() < 0.03:
            path += ("&" if "?" in path else "?") + "&".join(f"{letters(r.randrange(1, 6), 'abcdefgrstu')}={letters(r.randrange(6, 20), '0123456789abcdef')}" for _ in range(r.randrange(3, 8)))
        urls.append(r.choice(["http://", "https://", "https://"]) + host + path)
        y.append(bad)
    return urls, np.array(y, float)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = lambda s, chars: s[: min((k for k in map(s.find, chars) if k >= 0), default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


class Model:
    """Statistics of suffixes and tokens, trees over FEATURES and the calibrated cut."""

    def __init__(self, train: tuple[list[str | None], np.ndarray], held: tuple[list[str | None], np.ndarray], precision: float = PRECISION) -> None:
        self.suffixes, self.tokens = (self._odds(*train, keys) for keys in (lambda h: {_suffix(h)}, lambda h: set(_tokens(h))))
        x = lambda urls: np.array([self.features(u) for u in urls], float).reshape(-1, len(FEATURES))
        self.trees = Boosted(FEATURES).fit(x(train[0]), train[1]).calibrate(x(held[0]), held[1], precision)
        self.cut = min(self.trees.cut, 1e9)

    @staticmethod
    def _odds(urls: list[str | None], y: np.ndarray, keys) -> dict[str, float]:
        """The log-odds (4 decimals) of the commonest keys, smoothed towards 0; keys that occur once say nothing."""
        bad, good = Counter(), Counter()
        for u, label in zip(urls, y, strict=True):
            (bad if label else good).update(keys(parts(u)[0]))
        seen = sorted((k for k in {*bad, *good} if bad[k] + good[k] > 1), key=lambda k: (-(bad[k] + good[k]), k))[:TOKENS]
        return {k: round(math.log((bad[k] + 1) / (good[k] + 1)), 4) for k in sorted(seen) if "'" not in k and "\\" not in k}

    def features(self, url: str | None) -> list[float]:
        """FEATURES of a URL; columns_sql says the same in SQL."""
        host, path = parts(url)
        url = url or ""
        entropy = -sum(host.count(c) / len(host) * math.log(host.count(c) / len(host)) for c in set(host))
        query = url.partition("?")[2]
        odds = [self.tokens.get(t, 0.0) for t in _tokens(host)]
        return [
            len(url), len(host), len(path), path.count("/"), host.count(".") + 1, host.count("-"), round(sum(c in "0123456789" for c in url) / max(len(url), 1), 4), sum(c in "0123456789" for c in host), round(entropy, 4),
            query.count("=") if query else 0, self.suffixes.get(_suffix(host), 0.0), max([0.0, *odds]), round(sum(odds), 3),
        ]

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.score(np.array([self.features(u) for u in urls], float).reshape(-1, len(FEATURES)))


def _tokens(host: str) -> list[str]:
    """The parts of a host between dots and hyphens, but for its suffix."""
    return host.rpartition(".")[0].replace("-", ".").split(".")


@lru_cache(1)
def shipped() -> Model:
    return Model(labelled(SAMPLE, 21), labelled(SAMPLE, 22))


def fit(labelled_urls: DataFrame, url_col: str = "url", label_col: str = "label", most: int = SAMPLE, seed: int = 21, precision: float = PRECISION) -> Model:
    """A model from a table of URLs labelled 1 (unwanted) or 0; at most `most` rows to train on and as many to calibrate on are taken, by a seeded hash."""
    halves = sample(labelled_urls.select(url_col, label_col).where(F.col(label_col).isNotNull()), most, seed)
    return Model(*(([r[0] for r in rows], np.array([float(r[1]) for r in rows])) for rows in halves), precision)


def _lookup(key: str, values: dict[str, float], duck: bool) -> str:
    if not values:
        return "CAST(0 AS DOUBLE)"
    if duck:
        return f"coalesce(map([{', '.join(f"'{k}'" for k in values)}], [{', '.join(f'CAST({v:.4f} AS DOUBLE)' for v in values.values())}])[{key}], 0.0)"
    return f"coalesce(try_element_at(map({', '.join(f"'{k}', CAST({v:.4f} AS DOUBLE)" for k, v in values.items())}), {key}), 0D)"


def columns_sql(model: Model, duck: bool = False) -> dict[str, str]:
    """FEATURES over the columns url, host and path (never null), for Spark or DuckDB."""
    g = ", 'g'" if duck else ""
    only = lambda x, chars: f"length(regexp_replace({x}, '[^{chars}]', ''{g}))"
    last = "regexp_extract(host, '[^.]*$', 0)"
    name = "substr(host, 1, greatest(length(host) - length(regexp_extract(host, '[^.]*$', 0)) - 1, 0))"
    share = "((length(host) - length(replace(host, c, ''))) * CAST(1 AS DOUBLE) / length(host))"
    if duck:
        entropy = f"coalesce(list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: CASE WHEN c = '' THEN 0.0 ELSE -{share} * ln({share}) END)), 0.0)"
        odds = f"list_transform(string_split(replace({name}, '-', '.'), '.'), lambda t: {_lookup('t', model.tokens, True)})"
        most, total = f"greatest(0.0, list_max({odds}))", f"list_sum({odds})"
    else:
        entropy = f"aggregate(array_distinct(split(host, '')), 0D, (a, c) -> a - CASE WHEN c = '' THEN 0D ELSE {share} * ln({share}) END)"
        odds = f"transform(split(replace({name}, '-', '.'), '\\\\.'), t -> {_lookup('t', model.tokens, False)})"
        most, total = f"greatest(0D, array_max({odds}))", f"aggregate({odds}, 0D, (a, t) -> a + t)"
    query = "CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?')) ELSE '' END"
    return {
        "url_chars": "length(url)", "host_chars": "length(host)", "path_chars": "length(path)", "depth": only("path", "/"), "labels": f"{only('host', '.')} + 1", "hyphens": only("host", "-"),
        "digit_ratio": f"round({only('url', '0-9')} / CAST(greatest(length(url), 1) AS DOUBLE), 4)", "host_digits": only("host", "0-9"), "entropy": f"round({entropy}, 4)", "parameters": only(query, "="), "suffix": _lookup(last, model.suffixes, duck), "token_most": most, "token_sum": f"round({total}, 3)",
    }


def rule_sql(rules: tuple[tuple[str, str], ...], of: str) -> str:
    """The rule that fits host and path, the longest first (of equally long ones the first given): its text or verdict."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        host, slash, path = rule.partition("/")
        path = slash + path
        q = lambda s: "'" + s.replace("'", "''" if of.startswith("duck") else "\\'") + "'"
        cases.append(f"WHEN (host = {q(host)} OR right(host, {len(host) + 1}) = {q('.' + host)}) AND left(path, {len(path)}) = {q(path)} THEN {q(rule if of.endswith('rule') else verdict)}")
    return f"CASE {' '.join(cases)} ELSE NULL END" if cases else "CAST(NULL AS STRING)"


def _ruled(split: DataFrame, rules: DataFrame) -> DataFrame:
    """split (host, path, ...) with rule and by_rule, its verdict, from a table of rules (verdict, rule), by equi-joins on a host suffix and a path prefix of the rules' lengths. Of equal rules the least verdict holds, of equally long ones that fit the least text."""
    cut = rules.groupBy("rule").agg(F.min("verdict").alias("by_rule")).select("rule", "by_rule", F.expr("regexp_extract(rule, '^[^/]*', 0)").alias("r_host"), F.expr("regexp_extract(rule, '/.*$', 0)").alias("r_path"))
    sizes = sorted(r.n for r in cut.select(F.length("r_path").alias("n")).distinct().collect())  # at most as many as the longest rule has characters
    if not sizes:
        return split.withColumns({"rule": F.lit(None).cast("string"), "by_rule": F.lit(None).cast("string")})
    ends = split.select("host", "path").distinct().withColumn("r_host", F.explode(F.expr("transform(sequence(1, size(split(host, '\\\\.'))), k -> concat_ws('.', slice(split(host, '\\\\.'), k, size(split(host, '\\\\.')))))")))
    tried = ends.withColumn("r_path", F.explode(F.expr(f"transform(filter(array({', '.join(map(str, sizes))}), n -> n <= length(path)), n -> left(path, n))")))
    best = F.min(F.struct((-F.length("rule")).alias("k"), "rule", "by_rule")).alias("b")
    found = tried.join(cut, ["r_host", "r_path"]).groupBy(F.col("host").alias("f_host"), F.col("path").alias("f_path")).agg(best)
    return split.join(found, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left").withColumns({"rule": F.col("b.rule"), "by_rule": F.col("b.by_rule")}).drop("f_host", "f_path", "b")


def url_report(pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row. rules: (verdict, host/path) pairs, or a table of columns verdict and rule."""
    model = model or shipped()
    url = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rest = url.withColumn("rest", F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")).withColumn("raw", F.expr("regexp_extract(rest, '^[^/?#]*', 0)"))
    split = rest.withColumn("host", F.expr("translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")).withColumn("path", F.expr("regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0)"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    split = _ruled(split, rules) if isinstance(rules, DataFrame) else split.withColumns({"rule": F.expr(rule_sql(rules, "rule")), "by_rule": F.expr(rule_sql(rules, "verdict"))})
    measured = split.select(id_col, "host", "path", "rule", "by_rule", *(F.expr(v).cast("double").alias(f"x_{k}") for k, v in columns_sql(model).items()))
    scored = measured.withColumn("score", F.expr(model.trees.sql({k: f"x_{k}" for k in FEATURES})))
    verdict = f"coalesce(by_rule, CASE WHEN score >= {model.cut:.6f} THEN 'block' ELSE 'allow' END)"
    return scored.select(id_col, "host", "path", "rule", F.expr(verdict).alias("verdict"), "score")


def oracle() -> str:
    """DuckDB SQL for the query: rules and trees written out."""
    model = shipped()
    x = ", ".join(f"CAST({v} AS DOUBLE) AS x_{k}" for k, v in columns_sql(model, duck=True).items())
    lower = "translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        "WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), r AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u), "
        f"p AS (SELECT *, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM r), h AS (SELECT page_id, url, {lower} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM p), "
        f"m AS (SELECT page_id, host, path, {x} FROM h), s AS (SELECT *, {model.trees.sql({k: f'x_{k}' for k in FEATURES})} AS score FROM m) "
        f"SELECT page_id, host, path, {rule_sql(RULES, 'duck_rule')} AS rule, coalesce({rule_sql(RULES, 'duck_verdict')}, CASE WHEN score >= {model.cut:.6f} THEN 'block' ELSE 'allow' END) AS verdict FROM s"
    )
