"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans with a little context. Five labelers vote on each (base rule, shape,
gazetteer, context words, edges: yes, no, or abstain). Expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is, without any labels; its beliefs train a logistic
span classifier. Spans of the base rules always stand; the classifier adds further ones.

Only vote patterns reach the driver: at most kinds x 3**labelers rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

# Kinds in the order of the span list: the four base ones, then what the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
# Same matches as the base patterns, but linear on any text: runs are taken whole and begin where the
# one before ended or no character of the run stands before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
# Cheap tests that a text can hold a match at all.
GUARDS = {
    "email": "contains({t}, '@')",
    "ip": r"{t} RLIKE '[0-9]\\.[0-9]'",
    "card": r"{t} RLIKE '[0-9](?:[ -]?[0-9]){{11}}'",
    "phone": "contains({t}, '+')",
    "ssn": "{t} RLIKE '[0-9]-[0-9]{{2}}-[0-9]'",
    "iban": "{t} RLIKE '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}'",
    "name": r"{t} RLIKE '(?:Mr|Mrs|Ms|Dr|Prof)\\.?\\x20[A-Z]'",
}
# Gazetteers: fixed values.
_TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|au|ch|at|be|pl|br|jp|cn|in"
_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
_CARDS = "4|5[1-5]|2[2-7]|3[47]|30|36|38|35|6011|65|62"
_IBANS = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|TR"
_NAMES = "James|John|Mary|Anna|Maria|Peter|Paul|Hans|Pierre|Jean|Juan|Jose|Carlos|Marie|Thomas|Michael|Robert|David|Sarah|Laura|Emma|Julia|Martin|Daniel"
_CONTEXT = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|pay|ssn|social security|iban|bank|ip|host|address|name|signed|dear)[^A-Za-z0-9]{0,4}$"
LABELERS = ("rule", "shape", "gazetteer", "context", "edge")
_SPAN = "struct<k:int,s:int,e:int,v:string,b:string,a:string>"

_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN int(substring({_DIGITS}, -i, 1)) "
    f"WHEN int(substring({_DIGITS}, -i, 1)) > 4 THEN 2 * int(substring({_DIGITS}, -i, 1)) - 9 ELSE 2 * int(substring({_DIGITS}, -i, 1)) END) % 10 = 0"
)
_PARTS = "forall(split(x.v, '[.]'), q -> length(ltrim('0', q)) <= 3 AND int(right(concat('000', ltrim('0', q)), 3)) <= 255)"
BASE_CHECK = (
    f"CASE x.k WHEN 0 THEN true WHEN 1 THEN {_PARTS} WHEN 2 THEN length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} "
    f"WHEN 3 THEN length({_DIGITS}) BETWEEN 9 AND 15 ELSE false END"
)
_VOTES = {
    "rule": f"CASE WHEN x.k > 3 THEN 0 WHEN {BASE_CHECK} THEN 1 ELSE -1 END",
    "shape": f"""CASE x.k WHEN 0 THEN IF(x.v RLIKE '[.][A-Za-z]{{2,}}$', 1, -1)
        WHEN 1 THEN IF(x.v RLIKE '^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]', 1, -1)
        WHEN 2 THEN IF(length({_DIGITS}) IN (15, 16), 1, -1) WHEN 3 THEN IF(length({_DIGITS}) BETWEEN 10 AND 13, 1, -1)
        WHEN 4 THEN IF(x.v RLIKE '^(?:000|666|9)|-00-|0000$', -1, 1) WHEN 5 THEN IF(length(x.v) BETWEEN 15 AND 34, 1, -1)
        ELSE IF(x.v RLIKE ' [A-Z][a-z]+ [A-Z][a-z]+$', 1, 0) END""",
    "gazetteer": f"""CASE x.k WHEN 0 THEN IF(x.v RLIKE '(?i)[.](?:{_TLDS})$', 1, 0)
        WHEN 1 THEN IF(x.v RLIKE '^(?:0|10|127|255)[.]|^192[.]168[.]', -1, 0) WHEN 2 THEN IF({_DIGITS} RLIKE '^(?:{_CARDS})', 1, -1)
        WHEN 3 THEN IF({_DIGITS} RLIKE '^(?:{_CODES})', 1, -1) WHEN 5 THEN IF(x.v RLIKE '^(?:{_IBANS})', 1, -1)
        WHEN 6 THEN IF(x.v RLIKE ' (?:{_NAMES})(?: |$)', 1, 0) ELSE 0 END""",
    "context": f"IF(x.b RLIKE r'{_CONTEXT}', 1, 0)",
    "edge": "IF(x.b RLIKE '[A-Za-z0-9]$' OR x.a RLIKE '^[A-Za-z0-9]', -1, 1)",
}


def _found(kind: str) -> Column:
    """Spans of one pattern in ``__text``: places come from the lengths of the matches and of the texts between them."""
    guard = GUARDS[kind].format(t="`__text`")
    pattern = F.lit(PATTERNS[kind])
    none = F.expr("CAST(array() AS array<string>)")
    matches = F.when(F.expr(guard), F.regexp_extract_all("__text", pattern, F.lit(0))).otherwise(none)
    between = F.when(F.expr(guard), F.split("__text", PATTERNS[kind], -1)).otherwise(none)
    return matches, between


def candidates(docs: DataFrame) -> DataFrame:
    """Add ``__spans``: all proposed spans of the whole text (null: empty), those that a base rule refuses too."""
    out = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    for n, kind in enumerate(KINDS):
        matches, between = _found(kind)
        out = out.withColumn(f"__m{n}", matches).withColumn(f"__p{n}", between)
    parts = [
        f"""IF(size(__m{n}) = 0, CAST(array() AS array<{_SPAN}>), aggregate(sequence(0, size(__m{n}) - 1),
            named_struct('p', 0, 'o', CAST(array() AS array<{_SPAN}>)),
            (z, i) -> named_struct('p', z.p + length(__p{n}[i]) + length(__m{n}[i]), 'o', array_append(z.o,
                CAST(named_struct('k', {n}, 's', z.p + length(__p{n}[i]), 'e', z.p + length(__p{n}[i]) + length(__m{n}[i]), 'v', __m{n}[i],
                'b', right(__p{n}[i], 24), 'a', left(__p{n}[i + 1], 8)) AS {_SPAN}))), z -> z.o))"""
        for n in range(len(KINDS))
    ]
    # Digit runs too short for a card, and short ones of other kinds, are no candidates.
    useful = f"filter(concat({', '.join(parts)}), x -> x.k <> 2 OR length({_DIGITS}) BETWEEN 12 AND 19)"
    drop = ["__text", *[f"__{c}{n}" for c in "mp" for n in range(len(KINDS))]]
    return out.withColumn("__spans", F.expr(useful)).drop(*drop)


def voted(spans: str = "__spans") -> Column:
    """Spans with their votes and whether the base rule takes them, without texts."""
    votes = ", ".join(f"'{name}', {sql}" for name, sql in _VOTES.items())
    return F.expr(f"transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'base', {BASE_CHECK}, {votes}))")


def reliabilities(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Belief of each vote pattern, and the log odds each labeler's vote carries (labeler, vote + 1), by expectation-maximisation.

    Labelers are taken as independent given the truth; each kind has its own prior. Beliefs start at the mean vote.
    """
    belief = 1 / (1 + np.exp(-2.0 * patterns.sum(1)))
    odds = np.zeros((patterns.shape[1], 3))
    for _ in range(rounds):
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                at = patterns[:, j] == v
                yes = (counts * belief)[at].sum() + 1.0
                no = (counts * (1 - belief))[at].sum() + 1.0
                odds[j, v + 1] = np.log(yes / ((counts * belief).sum() + 3.0)) - np.log(no / ((counts * (1 - belief)).sum() + 3.0))
        score = odds[np.arange(patterns.shape[1])[None], patterns + 1].sum(1)
        for k in np.unique(kinds):
            at = kinds == k
            prior = ((counts * belief)[at].sum() + 1.0) / (counts[at].sum() + 2.0)
            score[at] += np.log(prior / (1 - prior))
        belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return belief, odds


def span_classifier(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray, belief: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (a constant per kind, then one per labeler) for the beliefs, by Newton steps."""
    x = np.concatenate([np.eye(len(KINDS))[kinds], patterns], 1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (belief - p)) - ridge * w
        hessian = (x * (counts * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(spans: DataFrame) -> np.ndarray:
    """Weights of the span classifier from a table with a ``votes`` array per document (see ``voted``)."""
    rows = spans.select(F.explode("votes").alias("x")).groupBy("x.k", *[f"x.{n}" for n in LABELERS]).count().collect()
    rows.sort()
    if not rows:
        return np.zeros(len(KINDS) + len(LABELERS))
    table = np.array([list(r) for r in rows], np.int64)
    kinds, patterns, counts = table[:, 0], table[:, 1:-1], table[:, -1].astype(float)
    belief, _ = reliabilities(patterns, counts, kinds)
    return span_classifier(patterns, counts, kinds, belief)


def decided(weights: np.ndarray, votes: str = "votes") -> Column:
    """All accepted spans as (start, kind, end, base), by start, then kind."""
    constants = "array(" + ", ".join(f"{w!r}D" for w in weights[: len(KINDS)].tolist()) + ")"
    score = f"{constants}[x.k]" + "".join(f" + {w!r}D * x.{n}" for n, w in zip(LABELERS, weights[len(KINDS) :].tolist()))
    return F.expr(
        f"""array_sort(transform(filter({votes}, x -> x.base OR ({score} >= 0D
            AND NOT exists({votes}, y -> y.base AND y.s < x.e AND x.s < y.e))), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'base', x.base)))"""
    )


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` for each row.

    A null or empty text has no spans (zero counts, the digest of the empty string, empty ``spans``). A null doc_id is
    kept, repeated rows are each searched, other columns are ignored, an empty table gives an empty result.
    Places are code points, ends exclusive. The model sees the votes of every span of the table.
    """
    seen = stage(candidates(docs.select("doc_id", "text")).select("doc_id", voted().alias("votes")), "votes")
    out = seen.select("doc_id", decided(fit(seen)).alias("found"))
    counts = [F.expr(f"CAST(size(filter(found, x -> x.base AND x.k = {n})) AS BIGINT)").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.expr(f"sha2({_listed('filter(found, x -> x.base)')}, 256)").alias("base_sha256"), F.expr(_listed("found")).alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each accepted span of ``text`` replaced by its kind in angle brackets and ``n_chars`` counted anew.

    Texts without spans, null ones too, stay as they are; overlapping spans are replaced together.
    """
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    proposed = candidates(docs).withColumn("__votes", voted()).drop("__spans")
    votes = stage(candidates(docs.select("text")).select(voted().alias("votes")), "votes")
    weights = fit(votes)
    discard(votes)
    found = proposed.withColumn("__found", decided(weights, "__votes")).drop("__votes")
    masked = F.expr(
        f"""IF(size(__found) = 0, text, aggregate(__found, named_struct('p', 0, 'o', ''),
            (z, x) -> named_struct('p', greatest(z.p, x.e), 'o', IF(x.s < z.p, z.o,
                concat(z.o, substring(text, z.p + 1, x.s - z.p), {names}[x.k]))), z -> concat(z.o, substring(text, z.p + 1))))"""
    )
    out = found.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
