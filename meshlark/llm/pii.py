"""Operator 5: personal data by candidate generators and gradient-boosted trees, in SQL expressions only.

Generators of high recall propose spans of several kinds, which may overlap.
Boosted trees score each proposal by its format (length, digits, groups, check
digit) and its context (cue words before it, characters it is glued to). Base
kinds are always redacted; a proposal of another kind is redacted if its score
reaches the calibrated cut and it doesn't overlap a base span. Base spans carry their scores as well.

`fit` trains the trees on the driver from a table of labelled spans, of which it
takes at most SAMPLE rows to train on and as many to calibrate on. Without a
table a shipped sample of as many made-up spans is used: sentences with personal
data, and with look-alikes (orders, versions, serials, counts, dates).

Defined results: null and empty texts have no spans; each row, repeated ones
too, gives one row; an empty table gives an empty result; only the id and text
columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, sample
from .shared import carries
from .spans import CONTEXT, found, literal, told

#: Labelled spans to train on, and as many to calibrate on (the bound of the sample).
SAMPLE = 4000
#: Held-out precision at the calibrated cut.
PRECISION = 0.99

_DIGITS = "length(regexp_replace($m, '[^0-9]', ''))"
_ODD = "try_cast(substring(reverse(regexp_replace($m, '[^0-9]', '')), i, 1) AS INT)"
_LUHN = f"aggregate(sequence(1, {_DIGITS}), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN {_ODD} WHEN {_ODD} > 4 THEN 2 * {_ODD} - 9 ELSE 2 * {_ODD} END) % 10 = 0"

#: kind, pattern, condition on a match $m, cheap condition on the text $t. Starts are held to the start of a run or the end of the last match, and runs
#: are possessive, so that long texts take neither quadratic time nor deep stacks; the matches are those of the plain patterns.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "TRUE", "contains($t, '@')"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"forall(split($m, '\\.'), p -> try_cast(p AS BIGINT) <= 255)", r"$t RLIKE '[0-9]\\.[0-9]'"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", f"CASE WHEN {_DIGITS} BETWEEN 16 AND 19 THEN {_LUHN} ELSE FALSE END", "$t RLIKE '[0-9]'"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 8 AND 15", "contains($t, '+')"),
)
MORE = (
    ("phone_local", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "TRUE", "$t RLIKE '[0-9]{3}[ .-][0-9]{4}'"),
    ("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "TRUE", "$t RLIKE '-[0-9]{2}-[0-9]{4}'"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", "TRUE", "$t RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'"),
    ("email_masked", r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}){1,4}", "TRUE", r"$t RLIKE '[(\\[] ?at ?[)\\]]'"),
    ("account", r"(?<![0-9A-Za-z.+-])[0-9]{7,15}(?![0-9A-Za-z.-])", "TRUE", "$t RLIKE '[0-9]{7}'"),
)
KINDS = [g[0] for g in BASE + MORE]
#: Cue words, matched in the lower-cased context before a span.
CUES = {"cue_phone": "(tel|phone|call|mobile|fax|whatsapp|reach|contact)", "cue_id": "(ssn|social sec|tax id|national id|passport|insurance)", "cue_bank": "(iban|account|bank|transfer|routing|acct)", "cue_mail": "(mail|write to|contact|reach)", "cue_other": "(order|invoice|isbn|version|build|part|ref|page|serial|sku|ticket|item|model|batch|tracking|lot|code|case)", "cue_count": "(total|population|votes|views|sold|about|over|some|than|of|usd|eur|worth|year|since|room)"}
FEATURES = ["kind", "chars", "digits", "letters", "gaps", "variety", "luhn", "glued_before", "glued_after", *CUES]


def features(kind: str, m: str, before: str, after: str) -> list[float]:
    """The features of one proposal; _sql_features says the same in SQL."""
    digits = re.sub("[^0-9]", "", m)
    total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
    low = before.lower()
    return [
        float(KINDS.index(kind)), float(len(m)), float(len(digits)), float(len(re.sub("[^A-Za-z]", "", m))), float(len(re.sub(r"[^\x20.()-]", "", m))), float(len(set(digits))), float(bool(digits) and total % 10 == 0),
        float(bool(re.search("[0-9A-Za-z]$", before))), float(bool(re.search("^[0-9A-Za-z]", after))), *(float(bool(re.search(p, low))) for p in CUES.values()),
    ]


def _sql_features(s: str) -> dict[str, str]:
    """Expressions for FEATURES of the span s."""
    m, digits = f"{s}.text", _DIGITS.replace("$m", f"{s}.text")
    before = f"{s}.before"
    number = {k: i for i, k in enumerate(KINDS)}
    as_number = "CAST({} AS DOUBLE)".format
    plain = {
        "kind": f"CASE {s}.kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in number.items()) + " END",
        "chars": f"length({m})", "digits": digits, "letters": f"length(regexp_replace({m}, '[^A-Za-z]', ''))", "gaps": f"length(regexp_replace({m}, '[^ .()-]', ''))",
        "variety": "(" + " + ".join(f"CAST(contains({m}, '{d}') AS INT)" for d in range(10)) + ")",
        "luhn": f"CASE WHEN {digits} > 0 THEN CAST({_LUHN.replace('$m', m)} AS INT) ELSE 0 END",
        "glued_before": f"CAST({before} RLIKE '[0-9A-Za-z]$' AS INT)", "glued_after": f"CAST({s}.after RLIKE '^[0-9A-Za-z]' AS INT)",
    }
    plain |= {k: f"CAST(lower({before}) RLIKE {literal(p)} AS INT)" for k, p in CUES.items()}
    return {k: as_number(v) for k, v in plain.items()}


#: Words of the shipped sample's sentences.
_PEOPLE, _PLACES = "anna jonas maria peter wei fatima omar lucia ivan chloe noah sofia liam emma raj mei".split(), "acme northwind lakeside citybank uni clinic bakery studio harbour museum".split()
_ENDINGS = ["com", "org", "net", "de", "co.uk", "edu", "io"]
_LEADS = {
    "email": ["you can write to ", "mail: ", "contact ", "from ", "his address is ", "cc "], "email_masked": ["write to ", "contact ", "mail me: ", "reach us: "], "ip": ["logged in from ", "client ", "address ", "host "], "card": ["paid with card ", "visa ", "charged to ", "account "],
    "phone": ["call ", "phone: ", "reach me on ", "fax "], "phone_local": ["call ", "tel. ", "phone: ", "mobile ", "contact "], "national_id": ["ssn: ", "social security number ", "tax id ", "insurance no. "], "iban": ["iban ", "transfer to ", "bank account "], "account": ["account ", "account no. ", "bank: ", "transfer to ", "phone ", "passport "],
}
_OTHER = ["order ", "invoice no. ", "isbn ", "version ", "build ", "part no. ", "ref. ", "serial ", "sku ", "ticket ", "model ", "tracking ", "lot ", "a total of ", "population ", "more than ", "sold ", "usd ", "since ", "page ", "code ", "case "]


def labelled(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """n made-up proposals: kind, text, what stands before and after, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(k))

    def luhn(k: int) -> str:
        body = d(k - 1)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    made = {
        "email": lambda y: f"{r.choice(_PEOPLE)}{r.choice(['.', '_', '', '-'])}{r.choice([*_PEOPLE, d(2)])}@{r.choice(_PLACES)}.{r.choice(_ENDINGS)}" if y else f"{r.choice(['git', 'v', 'img', 'no-reply'])}@{r.choice(['2x', '1.0', 'host'])}.{r.choice(['png', 'local', '0'])}",
        "email_masked": lambda y: f"{r.choice(_PEOPLE)} {r.choice(['(at)', '[at]'])} {r.choice(_PLACES)} {r.choice(['(dot)', '[dot]'])} {r.choice(_ENDINGS[:3])}",
        "ip": lambda y: ".".join(str(r.randrange(1, 256)) for _ in range(4)) if y else ".".join(str(r.randrange(10)) for _ in range(4)), "card": lambda y: r.choice([luhn(16), " ".join([d(4)] * 4), luhn(19)]) if y else d(16), "phone": lambda y: f"+{r.randrange(1, 99)} {d(3)} {d(r.randrange(4, 8))}",
        "phone_local": lambda y: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(r.randrange(200, 999), d(3), d(4)), "national_id": lambda y: f"{d(3)}-{d(2)}-{d(4)}", "iban": lambda y: upper(2) + d(2) + " " + " ".join(d(4) for _ in range(r.randrange(3, 6))) if y else upper(2) + d(2) + "".join(r.choice([upper(4), d(4)]) for _ in range(r.randrange(2, 4))),
        "account": lambda y: d(r.randrange(8, 13)) if y else r.choice([d(r.randrange(7, 15)), str(r.randrange(19500101, 20301231)), str(r.randrange(1, 99)) + "0" * 6]),
    }
    out = []
    for _ in range(n):
        kind, yes = r.choice(KINDS), r.random() < 0.5
        lead = r.choice(_LEADS[kind]) if yes and r.random() < 0.9 else r.choice(["", "and ", "the ", "then "]) if yes or r.random() < 0.2 else r.choice(_OTHER)
        before = " ".join(r.choice([*_PEOPLE, *_PLACES, "we", "was", "with", "later"]) for _ in range(r.randrange(0, 4))) + " " + (lead.capitalize() if r.random() < 0.2 else lead)
        after = r.choice([" ", ".", ",", ")", "", "\n"]) if yes or r.random() < 0.7 else r.choice(["x", "a", "-", "%", "/", "_"])
        out.append((kind, made[kind](yes), before[-CONTEXT:], after, int(yes)))
    return out


def _luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def trained(train: list[tuple], held: list[tuple], precision: float = PRECISION) -> Boosted:
    """Trees from labelled spans (kind, text, before, after, label) and the cut at which held-out ones are right this often."""
    x = lambda rows: np.array([features(*r[:4]) for r in rows], float).reshape(-1, len(FEATURES))
    y = lambda rows: np.array([r[4] for r in rows], float)
    return Boosted(FEATURES).fit(x(train), y(train)).calibrate(x(held), y(held), precision)


def fit(spans: DataFrame, most: int = SAMPLE, seed: int = 11, precision: float = PRECISION) -> Boosted:
    """A model from a table (kind, text, before, after, label 1 or 0); at most `most` rows to train on and as many to calibrate on are taken, by a seeded hash. Rows of other kinds, or without a text or label, are left out."""
    named = spans.select("kind", "text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")), F.col("label").cast("int").alias("label"))
    return trained(*sample(named.where(F.col("kind").isin(KINDS) & F.col("text").isNotNull() & F.col("label").isNotNull()), most, seed), precision)


@lru_cache(1)
def shipped() -> Boosted:
    return trained(labelled(SAMPLE, 11), labelled(SAMPLE, 12))


@carries
def proposed(docs: DataFrame, text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """docs with pii_spans (kind, start, stop, text, score, chosen): the proposals of all generators by kind, then start."""
    model = model or shipped()
    t = f"coalesce(`{text_col}`, '')"
    each = [found(t, p, kind, keep, may.replace("$t", t)) for kind, p, keep, may in BASE + MORE]
    columns = _sql_features("s")
    packed = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in columns.items()) + ")"
    score = model.sql({k: f"f.{k}" for k in FEATURES})
    base = ", ".join(f"'{g[0]}'" for g in BASE)
    scored = f"transform(_op_raw, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'text', s.text, 'score', transform(array({packed}), f -> {score})[0]))"
    chosen = f"transform(_op_scored, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'text', s.text, 'score', s.score, 'chosen', s.kind IN ({base}) OR (s.score >= {min(model.cut, 1e9):.6f} AND NOT exists(_op_scored, b -> b.kind IN ({base}) AND b.start < s.stop AND s.start < b.stop))))"
    out = docs.withColumn("_op_raw", F.expr(f"concat({', '.join(each)})")).withColumn("_op_scored", F.expr(scored)).withColumn("pii_spans", F.expr(chosen))
    return out.select(*(c for c in docs.columns if c != "pii_spans"), "pii_spans")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    base = [g[0] for g in BASE]
    kept = proposed(docs.select(id_col, text_col), text_col, model).select(id_col, F.expr("filter(pii_spans, s -> s.chosen)").alias("s"))
    counts = [F.expr(f"CAST(size(filter(s, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in base]
    only = "filter(s, x -> x.kind IN ({}))".format(", ".join(f"'{k}'" for k in base))
    return kept.select(id_col, *counts, F.sha2(F.expr(told(only)), 256).alias("base_sha256"), F.expr(told("s")).alias("spans"))
