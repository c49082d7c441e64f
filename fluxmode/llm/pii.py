"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

DataFrame functions only on the rows; the trees are grown on a table of counts. Validated formats
(email, ip, card, phone) are found as they are and stay. High-recall generators propose further,
overlapping spans of each kind: addresses with (at) and (dot) or with bare words, numbers with other
separators, bracketed dots or none, cards within longer runs of digits, phone numbers without their plus.

A candidate is labelled by its normalised value (at and dot restored, separators stripped): an address
with an alphabetic ending (between bare words one of ENDINGS, and a host that is no article), four octets, a card number that passes Luhn, or 10 to 15 digits that a plus,
an area code or a cue word marks as a phone number. No label asks for the validated format, and check sums, octets and endings are no features: what the trees learn is how often candidates of a format, in a context, are the
real thing (phone numbers have no check sum: there the marks themselves are features). Format and context are reduced to a few small integers, so all candidates of the corpus
fall into a bounded number of cells (at most the product of LEVELS), and cells with their counts are all
the driver gets. Trees are boosted on the cells with logistic loss. One fold of the documents calibrates
for each generator the least score from which on PRECISION of the candidates that pass are no chance
passes: what is not of a kind passes its check with about the share CHANCE, so the failures tell how many
passes are accidents. Candidates at or above it that pass and touch no validated span are redacted, too;
of accepted candidates that overlap, all are.

Null text is an empty text. Every row gives one result row, repeated ids included; rows are told apart
by their place in the scan. Patterns are possessive, so very long texts and runs cost one pass each. Ties
do not arise: equal scores are accepted alike. Extra columns are ignored by scan(). An empty table, or
one without candidates in both folds, gives no further spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stored

KINDS = ["email", "ip", "card", "phone"]
#: Validated formats. Runs are possessive and begin where a run begins: no second look at long texts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A dot between brackets, or spelled between them.
_DOT = r"(?:[(\[{]\.[)\]}]|\x20?[(\[{](?i:dot)[)\]}]\x20?)"
#: Endings and hosts by which "name at host dot org" is told from prose (fixed values).
ENDINGS, ARTICLES = "com|org|net|edu|gov|info|biz|io|co|us|uk|de|fr|es|it|eu", "a|an|the|this|that|each|every|one|my|your|our|his|her|its|their"
GENERATORS = {
    "email?": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|(?i:\(at\)|\[at\]|\{at\}))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?i:\(dot\)|\[dot\]|\{dot\})\x20?)[A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++",
    "ip?": rf"(?<![0-9])[0-9]{{1,4}}(?:(?:[.,:]|{_DOT})[0-9]{{1,4}}){{3}}(?![0-9])",
    "card?": r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){11,}+",
    "group?": r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[\x20./_-][0-9]{4}){3})(?![0-9])",
    "phone?": r"(?<![0-9])(?:\+\x20?)?[(]?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+",
}
#: What each generator proposes, and how often something else passes that kind's check.
KIND_OF = {"email?": "email", "ip?": "ip", "card?": "card", "group?": "card", "phone?": "phone"}
CHANCE = {"email?": 0.5, "ip?": 0.3, "card?": 0.1, "group?": 0.1, "phone?": 0.5}
#: Words that announce a kind, looked for in what stands before a candidate.
CUES = {"email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|account|pay", "phone": "tel|phone|call|mobile|fax|cell"}
#: Cells: generator, digits, digit groups, separator, before, after, opening, cue.
LEVELS = {"gen": 5, "digits": 6, "groups": 5, "sep": 6, "before": 4, "after": 4, "open": 3, "cue": 2}
#: A leak costs more than a redaction too many: one accepted candidate in five may be a chance pass.
ROUNDS, RATE, PRECISION = 30, 0.4, 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column, joint: str) -> Column:
    """Whether all parts of a value between joints are at most 255."""
    return F.forall(F.split(value, joint), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def _valid(kind: Column, value: Column) -> Column:
    """Whether a value of a kind (with or without question mark) is a validated span."""
    kind, n = F.regexp_replace(kind, r"\?$", ""), F.length(_digits(value))
    return (
        F.when(kind == "email", value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]++)++$"))
        .when(kind == "ip", value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & _octets(value, r"\."))
        .when(kind == "card", value.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & n.between(14, 19) & F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))"))
        .when(kind == "phone", value.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$") & n.between(10, 15))
        .otherwise(False)
    )


def _cue() -> Column:
    cue = F.lit(False)
    for g, kind in KIND_OF.items():
        cue = F.when(F.col("kind") == g, F.lower("before").rlike(CUES[kind])).otherwise(cue)
    return F.coalesce(cue, F.lit(False))


def _passes() -> Column:
    """Whether the normalised value of a candidate is one of its kind: the label of the trees."""
    kind, value = F.col("kind"), F.col("value")
    address = F.regexp_replace(F.regexp_replace(value, r"(?i)\x20?[(\[{]at[)\]}]\x20?|\x20?@\x20?|\x20at\x20", "@"), r"(?i)\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20", ".")
    prose = value.rlike(r"(?i)\x20at\x20") & (~value.rlike(rf"(?i)\x20(?:{ENDINGS})$") | value.rlike(rf"(?i)\x20at\x20(?:{ARTICLES})\x20"))
    joined = F.regexp_replace(value, _DOT, ".")
    n = F.length(_digits(value))
    marked = value.rlike(r"^\+|^[(][0-9]{2,5}+[)]") | _cue()
    return F.coalesce(
        F.when(kind == "email?", address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)*+$") & address.rlike(r"\.[A-Za-z]{2,24}$") & ~prose)
        .when(kind == "ip?", _octets(joined, "[.,:]") & ~joined.rlike(r"(^|[.,:])0[0-9]") & (joined.rlike(r"^[0-9.]++$") | _cue()))
        .when(kind.isin("card?", "group?"), n.between(14, 19) & F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))"))
        .otherwise(n.between(10, 15) & marked),
        F.lit(False),
    )


def _cells() -> dict[str, Column]:
    kind, value = F.col("kind"), F.col("value")
    bins = lambda c, *edges: sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))
    side = lambda c: F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}_]$"), 1).when(c.rlike(r"^[0-9]$"), 2).otherwise(3)
    seps = F.array_distinct(F.split(F.regexp_replace(value, r"[^ ./_:,@()\[\]{}-]", ""), ""))
    marks = F.array_join(F.array_sort(F.array_remove(seps, "")), "")
    return {
        "gen": spans.order_of(list(GENERATORS), kind),
        "digits": bins(F.length(_digits(value)), 7, 10, 14, 16, 20),
        "groups": F.least(F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))), F.lit(4)),
        "sep": F.when(marks == "", 0).when(marks == " ", 1).when(marks == "-", 2).when(F.contains(marks, F.lit("@")), 3).when(marks == ".", 4).otherwise(5),
        "before": side(F.right("before", F.lit(1))),
        "after": side(F.left("after", F.lit(1))),
        "open": F.when(F.startswith(value, F.lit("+")), 2).when(value.rlike(r"^[(][0-9]{2,5}+[)]"), 1).otherwise(0),
        "cue": _cue().cast("int"),
    }


class Boosted:
    """Trees of two levels over cells: (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
        p = (w @ y + 0.5) / (w.sum() + 1)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            f, c = self._split(x, g, h, np.ones(len(y), bool))
            low = x[:, f] <= c
            tree = [f, c]
            for side in (low, ~low):
                f2, c2 = self._split(x, g, h, side)
                leaves = [float(rate * g[m].sum() / (h[m].sum() + 1.0)) for m in (side & (x[:, f2] <= c2), side & (x[:, f2] > c2))]
                tree.append((f2, c2, *leaves))
            self.trees.append(tree)
            score = self.score(x)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        best = (-1.0, 0, 0)
        for f in range(x.shape[1]):
            for c in np.unique(x[rows, f])[:-1]:
                low = rows & (x[:, f] <= c)
                high = rows & ~low
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
                if gain > best[0]:
                    best = (float(gain), f, int(c))
        return best[1], best[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, c, low, high in self.trees:
            a, b = (np.where(x[:, s[0]] <= s[1], s[2], s[3]) for s in (low, high))
            out += np.where(x[:, f] <= c, a, b)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(self.start)
        for f, c, *sides in self.trees:
            a, b = (F.when(F.col(names[s[0]]) <= s[1], s[2]).otherwise(s[3]) for s in sides)
            out = out + F.when(F.col(names[f]) <= c, a).otherwise(b)
        return out


def thresholds(model: Boosted, x: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float = PRECISION, chance: dict[int, float] | None = None) -> dict[int, float]:
    """For each generator (column 0) the least score at or above which at most 1 - precision of the passes are accidents.

    Of what is not of a kind, the share chance passes all the same: f failures stand for f * chance / (1 - chance) such passes.
    """
    out, score = {}, model.score(x)
    for g in np.unique(x[:, 0]):
        own, c = x[:, 0] == g, (chance or {}).get(int(g), 0.5)
        for t in np.unique(score[own]):
            at = own & (score >= t)
            passed = n[at] @ y[at]
            if passed and (n[at].sum() - passed) * c / (1 - c) <= (1 - precision) * passed:
                out[int(g)] = float(t) - 1e-9
                break
    return out


def matches(docs: DataFrame) -> DataFrame:
    """rid, doc_id, kind, start, stop, value, base: validated spans and accepted candidates; a null kind for each document."""
    text = F.col("text")
    digits = text.rlike(r"[0-9](?:[^0-9]{0,3}[0-9]){6}")
    gates = {
        "email": F.contains(text, F.lit("@")), "email?": F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[{]at[)\]}]|\x20dot\x20"), "phone": F.contains(text, F.lit("+")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "ip?": text.rlike(r"[0-9][.,:][0-9]{1,4}+[.,:][0-9]") | text.rlike(rf"[0-9]{_DOT}[0-9]"), "card": digits, "card?": digits, "group?": digits, "phone?": digits,
    }
    located = spans.located(docs, BASE | GENERATORS, gates)
    proposed = F.endswith(F.col("kind"), F.lit("?"))
    passes = F.when(proposed, _passes()).otherwise(F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False)))
    found = stored(located.withColumn("ok", passes).where(F.col("kind").isNull() | proposed | F.col("ok")).withColumns(_cells()), "pii-candidates")
    base = found.where(F.col("kind").isNull() | ~proposed).select("rid", "doc_id", "kind", "start", "stop", "value", F.lit(True).alias("base"))
    names = list(LEVELS)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0).alias("held")
    cells = found.where(proposed).groupBy(*names, F.col("ok").cast("int").alias("y"), held).agg(F.count("*").alias("n")).collect()  # bounded by LEVELS
    fold = {h: [r for r in cells if bool(r["held"]) is h] for h in (False, True)}
    if not fold[False] or not fold[True]:
        return base
    x, y, n = ({h: np.array([[r[c] for c in names] for r in rows]) for h, rows in fold.items()}, *({h: np.array([r[c] for r in rows], float) for h, rows in fold.items()} for c in ("y", "n")))
    model = Boosted(x[False], y[False], n[False])
    limit = F.lit(None).cast("double")
    chance = {i: CHANCE[g] for i, g in enumerate(GENERATORS)}
    for g, t in thresholds(model, x[True], y[True], n[True], chance=chance).items():
        limit = F.when(F.col("gen") == g, t).otherwise(limit)
    sure = found.where("kind IS NOT NULL").where(~proposed | (F.col("ok") & (model.column(names) >= limit)))
    named = F.lit(None).cast("string")
    for g, kind in KIND_OF.items():
        named = F.when(F.col("kind") == g, kind).otherwise(named)
    more = sure.withColumn("apart", spans.apart(~proposed)).where(proposed & F.col("apart"))
    more = more.select("rid", "doc_id", named.alias("kind"), "start", "stop", "value", F.lit(False).alias("base")).distinct()  # two generators may agree
    return base.unionByName(more)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = matches(docs)
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    base = spans.joined(KINDS, F.col("base") & F.col("kind").isNotNull())
    return found.groupBy("rid", "doc_id").agg(*counts, F.sha2(base, 256).alias("base_sha256"), spans.joined(KINDS, F.col("kind").isNotNull()).alias("spans")).drop("rid")
