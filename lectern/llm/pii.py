"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from patterns and stay as they are. Wider patterns propose further candidates. Labelers (pattern,
checksum, gazetteer, context before, shape) vote +1, 0 or -1 on every candidate. The votes meet as counts per vote
pattern, of which there are a few hundred at most; on those, expectation-maximisation estimates each labeler's
reliability, and a logistic span classifier is fitted to the posteriors. It comes back as one expression.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, save, whole

KINDS = ("email", "ip", "card", "phone")
#: Possessive groups match what the plain ones do, since nothing that follows could take characters back, and Java
#: loops over them without recursion. A match of the local part starts where its run does, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that any text with a valid match passes.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
#: Wider patterns; what they find is a candidate only.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}+\x20?[(\[]\x20?at\x20?[)\]]\x20?[a-z0-9-]{1,63}+(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?[a-z0-9-]{1,63}+){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+)(-])(?<![0-9+)][\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
WIDE_HINT = {
    "email": lambda t: t.rlike(r"(?i)[(\[]\x20?at\x20?[)\]]"),
    "ip": lambda t: t.rlike(r"(?i)[0-9a-f]:[0-9a-f]++:[0-9a-f]++:"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.)-]\x20?[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Gazetteers and context words.
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl"
CARD_HEADS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|ipv4|ipv6|address|host|server|from|login)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b",
}
AGAINST = r"(?i)(?:\b(?:isbn|version|v|order|invoice|page|id|no|token|sha|hash|key|section|serial|ref)\W{0,3}|[$#=\"])$"
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    """What a base match must pass."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(hit)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost matches, in code points, from the pieces between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    start = lambda a, x: a["at"] + F.length(x["gap"])
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (start(a, x) + F.length(x["hit"])).alias("at"),
            F.array_append(a["out"], F.struct(start(a, x).alias("start"), (start(a, x) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _votes(kind: str, base: bool, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    digits, vote = _digits(hit), lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    checks = {
        "email": F.lit(0),
        "ip": vote(_valid("ip", hit), F.lit(False)),
        "card": vote(F.coalesce(F.call_function("luhn_check", digits), F.lit(False)), F.lit(True)),
        "phone": vote(F.length(digits).between(10, 13), ~F.length(digits).between(8, 15)),
    }
    lists = {
        "email": vote(hit.rlike(rf"(?i)(?:{TLDS})$"), F.lit(False)),
        "ip": vote(F.lit(False), hit.rlike(r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\.")),
        "card": vote(digits.rlike(CARD_HEADS), F.lit(True)),
        "phone": vote(F.lit(False), digits.rlike(r"^(?:0{3}|[01]{3})")),
    }
    shapes = {
        "email": vote(F.length(hit) <= 64, F.length(hit) > 128),
        "ip": vote(~hit.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)),
        "card": vote(F.length(digits) == 16, ~F.length(digits).isin(14, 15, 16, 19)),
        "phone": vote(hit.rlike(r"[()]"), F.lit(False)),
    }
    joined = before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]")
    return {
        "pattern": F.lit(1 if base else 0),
        "checksum": checks[kind],
        "gazetteer": lists[kind],
        "context": vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
        "shape": F.when(joined, -1).otherwise(shapes[kind]),
    }


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (docs' columns as one struct, so that no name clashes) and ``_c``: array<struct<kind int, start, end, base,
    the labelers' votes>> of each whole text.

    A null text counts as empty. Wide candidates that touch a base span of the same text are left out.
    """
    docs = docs.select(whole(docs.columns))
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def struct(kind: str, base: bool, m: Column, t: Column) -> Column:
        before = F.substring(t, F.greatest(m["start"] - 29, F.lit(1)), F.least(m["start"], F.lit(30)))
        votes = _votes(kind, base, m["hit"], before, F.substring(t, m["end"] + 1, F.lit(1)))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), *(votes[x].alias(x) for x in LABELERS))

    # Spark counts a lambda's parameters, so the kind is bound by a function and not by a default.
    valid = lambda k: lambda m: _valid(k, m["hit"])
    made = lambda k, base: lambda m: struct(k, base, m, text)
    found = docs.withColumns({f"_{k}": F.when(HINT[k](text), F.filter(matches(text, PATTERN[k]), valid(k))).otherwise(none) for k in KINDS})
    found = found.withColumns({f"_w_{k}": F.when(WIDE_HINT[k](text), matches(text, WIDE[k])).otherwise(none) for k in KINDS})
    held = F.concat(*(F.col(f"_{k}") for k in KINDS))
    base = [F.transform(f"_{k}", made(k, True)) for k in KINDS]
    free = lambda m: ~F.exists(held, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    wide = [F.transform(F.filter(f"_w_{k}", free), made(k, False)) for k in KINDS]
    return found.withColumn("_c", F.concat(*base, *wide)).drop(*(f"_{k}" for k in KINDS), *(f"_w_{k}" for k in KINDS))


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of true spans, for each labeler {vote: (P(vote | true), P(vote | false))}) from counts of vote patterns."""
    total = sum(n for _, n in counts) or 1.0
    prior, m = 0.5, len(LABELERS)
    table = [{1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for _ in range(m)]
    for _ in range(rounds):
        post = [posterior(v, prior, table) for v, _ in counts]
        # A weak prior count keeps every probability off 0 and 1.
        true = sum(p * n for p, (_, n) in zip(post, counts, strict=True))
        prior = (true + 1) / (total + 2)
        for j in range(m):
            yes = {x: 0.5 for x in (1, 0, -1)}
            no = {x: 0.5 for x in (1, 0, -1)}
            for p, (v, n) in zip(post, counts, strict=True):
                yes[v[j]] += p * n
                no[v[j]] += (1 - p) * n
            table[j] = {x: (yes[x] / sum(yes.values()), no[x] / sum(no.values())) for x in (1, 0, -1)}
    return prior, table


def posterior(votes: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(1, len(KINDS))), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes)]


def span_classifier(counts: list[tuple[int, tuple[int, ...], float]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier of (kind, votes) fitted to the EM posteriors; a small problem, so plain numbers."""
    size = 4 + 2 * len(LABELERS) if not counts else len(_features(*counts[0][:2]))
    weights = [0.0] * size
    if not counts:
        return weights
    pooled: dict[tuple[int, ...], float] = {}
    for _, v, n in counts:
        pooled[v] = pooled.get(v, 0.0) + n
    prior, table = reliabilities(sorted(pooled.items()))
    total = sum(n for _, _, n in counts)
    rows = [(_features(k, v), n / total, posterior(v, prior, table)) for k, v, n in counts]
    for _ in range(steps):
        grad = [1e-4 * w for w in weights]
        for x, n, y in rows:
            z = sum(w * f for w, f in zip(weights, x, strict=True))
            err = (1 / (1 + math.exp(-z)) - y) * n
            for j, f in enumerate(x):
                grad[j] += err * f
        weights = [w - rate * g * 4 for w, g in zip(weights, grad, strict=True)]
    return weights


def learn(found: DataFrame) -> list[float]:
    """The span classifier's weights from the candidates of all rows; what is collected is one row per vote pattern."""
    spans = found.select(F.explode("_c").alias("c"))
    got = spans.groupBy("c.kind", *(f"c.{x}" for x in LABELERS)).agg(F.count("*").alias("n")).collect()
    return span_classifier(sorted((r["kind"], tuple(r[x] for x in LABELERS), float(r["n"])) for r in got))


def accepted(weights: list[float], threshold: float = 0.9, min_yes: int = 2) -> Column:
    """The spans to report: base ones, and candidates with min_yes votes for them that score at or over the threshold.

    Two added spans of one kind that overlap do not occur: each wide pattern's matches are apart.
    """
    cut = math.log(threshold / (1 - threshold))

    def keep(c: Column) -> Column:
        z, k = F.lit(weights[0]), 1
        for kind in range(1, len(KINDS)):
            z, k = z + F.when(c["kind"] == kind, weights[k]).otherwise(0.0), k + 1
        for value, name in itertools.product((1, -1), LABELERS):
            z, k = z + F.when(c[name] == value, weights[k]).otherwise(0.0), k + 1
        yes = sum((F.when(c[name] == 1, 1).otherwise(0) for name in LABELERS), F.lit(0))
        return c["base"] | ((z >= cut) & (yes >= min_yes))

    return F.filter("_c", keep)


def written(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    slim = F.sort_array(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(slim, lambda c: F.concat_ws(":", name(c["kind"]), c["start"], c["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans (array of kind, start, end, base and votes) as the model accepts them.

    Null ids and repeated rows keep their rows; a null or empty text has no span; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = save(candidates(own).select("doc.id", "_c"), "pii")
    return found.select(F.col("id").alias(id_col), accepted(learn(found)).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every accepted span of the text replaced by its kind in brackets; of overlapping spans the first names both.

    A null text stays null; repeated rows each keep their row; an empty table gives an empty result. Columns of any name
    keep their values.
    """
    # Candidates are found twice, which costs less than writing every text with them; learning reads a narrow table, since
    # Spark would push the explode's filter into the expressions that made them.
    weights = learn(save(candidates(docs.select(F.col(f"`{text_col}`").alias("text"))).select("_c"), "pii"))
    found = candidates(docs, text_col)
    spans = F.sort_array(F.transform(accepted(weights), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    name = lambda k: F.get(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k)
    text = F.col(f"doc.`{text_col}`")
    # A span that starts inside the last one only moves its end.
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), name(x["kind"]))).alias("out"),
        ),
    )
    changed = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    new = F.when(F.size("_c") > 0, changed).otherwise(text).alias(text_col)
    return found.select(*(new if c == text_col else p for c, p in zip(docs.columns, parts(docs.columns), strict=True)))
