"""Operator 9: personal data by weak supervision, in DataFrame functions alone.

Candidates are the base matches (e-mail, IP, card and phone patterns), looser forms of the same
four kinds, and secrets: runs of 20 to 512 characters that hold letters and digits, as access tokens and
keys do. Four labelers vote on every candidate: the strict pattern with its arithmetic, a
gazetteer (top-level domains, address blocks, issuer prefixes, country codes), cue words in the
text before it, and the characters around it; for a secret the strict labeler wants an issuer's prefix or
that it is assigned to something, the gazetteer usual lengths of digests and mixed characters. Vote patterns are counted over the whole corpus in
Spark; there are at most 16 for each kind, so that table is bounded. Expectation-maximisation on it
estimates each labeler's reliability and each pattern's chance of being real, and a logistic
classifier is trained on these. A looser candidate becomes a span if the classifier says so; base
matches always stay.

Positions come from ``split`` and ``regexp_extract_all`` by the same pattern: gaps and matches in
turn, whose lengths are added up block by block. All patterns are written so that Java's engine runs
them without recursion or rescanning. Time is about linear in a text's length, however many matches it
holds: what lies around a span, and what stays of a redacted text, is cut from pieces of bounded length,
and base spans that a looser one meets are found by halving.

Defined results: null text counts as empty; very long texts are read whole; a document without candidates has zero counts, the
digest of the empty text and empty spans; repeated rows get equal results; without any
candidate in the corpus the classifier accepts nothing; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import written

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")  # secrets have looser candidates alone

_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",  # whole runs of 13 to 19 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][0-9\x20-]{11,}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
LOOSE = {
    "email": _LOCAL + r"\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9A-Za-z._/])",
    "phone": r"(?<![0-9A-Za-z+(._-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z_])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,512}+(?![A-Za-z0-9+/_-])",
}
LOOSE_HINT = {"email": r"[(\[](?:at|AT)[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9]{4}[._/][0-9]{4}",
              "phone": r"[0-9]{3}[).\x20-]{1,2}[0-9]{3}[.-][0-9]{4}", "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"}
# FIXED VALUES of the labelers: gazetteers and cue words.
KNOWN = {
    "email": r"(?i)[.)\]\x20](com|org|net|edu|gov|int|info|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca)$",
    "ip": r"(?i)^(?!0+\.|127\.|22[4-9]\.|2[3-5][0-9]\.)[0-9]|^(2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "secret": r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|"
              r"^(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9][^0-9]*[0-9])[A-Za-z0-9+/_-]+$",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
}
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|kontakt|correo|courriel|from|to)\b",
    "ip": r"(?i)\b(ip|host|server|address|from|login|adresse|addr)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "secret": r"(?i)(token|secret|passw|pwd|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential)",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|cell|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
}
#: Prefixes by which issuers mark their tokens; a name given a value.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|pk_live_|rk_live_|AIza|ya29|eyJ|npm_|pypi-|SG|hf_)"
ASSIGNED = r"[A-Za-z0-9_\x22'\])]\x20?(?:=|:|=>|:=)\x20?[\x22'`]?$|(?i)\b(bearer|basic)\x20$"
LABELERS = ("strict", "known", "cue", "apart")

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit sum."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Arithmetic that a base match must pass."""
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, merge, block: int = 256) -> Column:
    """For every integer of an array all earlier ones merged, from 0 on.

    An array grows by being copied, so it is grown within blocks, from the blocks' own merged values.
    """
    def grown(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.array(first), lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
                           lambda b: F.slice(v, b * block + 1, F.lit(block)))

    def offsets(parts: Column) -> Column:
        return grown(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), merge)), F.lit(0))

    def scanned(parts: Column) -> Column:
        return _let(offsets(parts), lambda first: F.flatten(F.transform(
            parts, lambda p, i: F.slice(grown(p, F.get(first, i)), F.lit(1), F.size(p)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), scanned)).otherwise(F.array().cast("array<int>")))


def _pieces(text: Column) -> Column:
    """A text in pieces of 256 code points."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,256}"), 0)


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start to end, exclusive, of a text in pieces."""
    first = F.floor(start / 256).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / 256).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start % 256 + 1, end - start)).otherwise("")


def _found(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """For every (pattern, hint) the matches as structs (start, end, s), ends exclusive, in code points."""
    kind = "array<struct<start:int,end:int,s:string>>"

    def placed(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def one(before: Column):
            def span(h: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("s"))
            return F.transform(hits, span)

        return F.coalesce(F.when(pair.isNotNull(), _let(_before(lengths, lambda a, b: a + b), one)).cast(kind), F.array().cast(kind))

    def pair(pattern: str, hint: str) -> Column:
        return F.when(text.rlike(hint), F.struct(F.split(text, pattern, -1).alias("gaps"),
                                                 F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")))

    return F.transform(F.array(*[pair(*p) for p in patterns]), placed)


def _meets(x: Column, spans: Column) -> Column:
    """Whether a span overlaps one of an array of disjoint spans in their order."""
    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        past, going = F.get(spans, mid)["end"] <= x["start"], acc["low"] < acc["high"]
        return F.struct(F.when(going & past, mid + 1).otherwise(acc["low"]).alias("low"),
                        F.when(going & ~past, mid).otherwise(acc["high"]).alias("high"))

    bounds = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    first = F.aggregate(steps, bounds, halve, lambda acc: acc["low"])
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, first)["start"] < x["end"], F.lit(False))).otherwise(False)


def _passing(kind: str):
    return lambda x: valid(kind, x["s"])


def _seen(text: Column, lists: Column) -> Column:
    """Arrays of spans, each span with up to 32 code points before it and the one on either side."""
    def one(pieces: Column):
        def seen(x: Column) -> Column:
            before = _cut(pieces, F.greatest(x["start"] - 32, F.lit(0)), x["start"])
            around = F.concat(F.substring(before, -1, 1), _cut(pieces, x["end"], x["end"] + 1))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), before.alias("before"), around.alias("around"))
        return F.transform(lists, lambda spans: F.transform(spans, seen))

    return F.when(F.size(F.flatten(lists)) > 0, _let(_pieces(text), one))


def _votes(kind: str, spans: Column, strict: bool) -> Column:
    """Spans with their vote pattern: four characters, 1 for a vote and 0 for none."""
    def one(x: Column) -> Column:
        core = _digits(x["s"]) if kind == "card" else x["s"]
        sure = x["s"].rlike(ISSUED) | x["before"].rlike(ASSIGNED) if kind == "secret" else F.lit(strict)
        votes = [sure, core.rlike(KNOWN[kind]), x["before"].rlike(CUES[kind]), ~x["around"].rlike(r"[\p{L}\p{N}_]")]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
                        F.concat(*[v.cast("int").cast("string") for v in votes]).alias("votes"))

    return F.coalesce(F.transform(spans, one), F.array().cast("array<struct<start:int,end:int,s:string,votes:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: base_<kind> and loose_<kind> arrays of (start, end, s, votes); secrets are loose only."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = [(BASE[k], HINT[k]) for k in KINDS] + [(LOOSE[k], LOOSE_HINT[k]) for k in ALL]
    src = src.select("*", _found(F.col("text"), patterns).alias("found"))
    passing = [F.filter(F.get("found", F.lit(i)), _passing(k)) for i, k in enumerate(KINDS)]
    src = src.select("doc_id", "text", F.array(*passing).alias("base"), F.slice("found", len(KINDS) + 1, len(ALL)).alias("loose"))
    free = lambda x: ~F.exists("base", lambda taken: _meets(x, taken))
    src = src.select("doc_id", "text", F.concat("base", F.transform("loose", lambda spans: F.filter(spans, free))).alias("lists"))
    src = src.select("doc_id", "text", _seen(F.col("text"), F.col("lists")).alias("seen"))
    out = [_votes(k, F.get("seen", F.lit(i)), True).alias(f"base_{k}") for i, k in enumerate(KINDS)]
    out += [_votes(k, F.get("seen", F.lit(i + len(KINDS))), False).alias(f"loose_{k}") for i, k in enumerate(ALL)]
    return src.select("doc_id", *(["text"] if keep_text else []), *out)


def vote_counts(cands: DataFrame) -> dict[tuple[str, str], int]:
    """How often each vote pattern occurs: at most 16 for each kind, counted over all rows."""
    named = lambda name, k: F.transform(f"{name}_{k}", lambda x: F.concat(F.lit(k + " "), x["votes"]))
    every = F.concat(*[named("base", k) for k in KINDS], *[named("loose", k) for k in ALL])
    rows = cands.select(F.explode(every).alias("p")).groupBy("p").count().collect()
    return {tuple(r["p"].split(" ")): r["count"] for r in rows}


def expectation_maximisation(counts: dict[tuple[str, str], int], rounds: int = 50) -> tuple[dict, dict]:
    """(posterior of every pattern, per kind and labeler the rates of a vote on real and other candidates).

    The labelers are taken as independent given the truth; add-one smoothing keeps rates inside (0, 1).
    """
    posterior, rates = {}, {}
    for kind in sorted({k for k, _ in counts}):
        rows = [([int(c) for c in v], n, v) for (k, v), n in sorted(counts.items()) if k == kind]
        total, prior = sum(n for _, n, _ in rows), 0.7
        yes, no = [0.8] * len(LABELERS), [0.2] * len(LABELERS)
        for _ in range(rounds):
            real = []
            for votes, _, _ in rows:
                a = math.log(prior) + sum(math.log(y if v else 1 - y) for v, y in zip(votes, yes))
                b = math.log(1 - prior) + sum(math.log(y if v else 1 - y) for v, y in zip(votes, no))
                real.append(1 / (1 + math.exp(min(700.0, b - a))))
            mass = sum(p * n for p, (_, n, _) in zip(real, rows))
            prior = (mass + 1) / (total + 2)
            for i in range(len(LABELERS)):
                hit = sum(p * n for p, (v, n, _) in zip(real, rows) if v[i])
                other = sum((1 - p) * n for p, (v, n, _) in zip(real, rows) if v[i])
                yes[i], no[i] = (hit + 1) / (mass + 2), (other + 1) / (total - mass + 2)
        posterior |= {(kind, v): p for p, (_, _, v) in zip(real, rows)}
        rates[kind] = {name: (yes[i], no[i]) for i, name in enumerate(LABELERS)}
    return posterior, rates


def train_classifier(counts: dict, posterior: dict, rounds: int = 300, rate: float = 1.0) -> dict[tuple[str, str], float]:
    """Chance of being real for every possible pattern, by logistic regression on the posteriors.

    Features: a bias for the kind, its four votes, and how many agree; patterns weigh by the
    logarithm of their count, so that rare forms are heard.
    """
    out = {}
    for kind in sorted({k for k, _ in counts}):
        rows = [(_features(v), posterior[kind, v], math.log1p(n)) for (k, v), n in sorted(counts.items()) if k == kind]
        w, mass = [0.0] * len(rows[0][0]), sum(n for _, _, n in rows)
        for _ in range(rounds):
            grad = [0.01 * x for x in w]
            for x, p, n in rows:
                miss = n / mass * (_logistic(w, x) - p)
                grad = [g + miss * f for g, f in zip(grad, x)]
            w = [a - rate * g for a, g in zip(w, grad)]
        out |= {(kind, format(i, "04b")): _logistic(w, _features(format(i, "04b"))) for i in range(16)}
    return out


def _features(votes: str) -> list[float]:
    v = [float(c) for c in votes]
    return [1.0, *v, sum(v) / len(v)]


def _logistic(w: list[float], x: list[float]) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))


def fit(cands: DataFrame) -> dict[tuple[str, str], float]:
    """The span classifier for a corpus: a chance for each kind and vote pattern (80 at most)."""
    counts = vote_counts(cands)
    return train_classifier(counts, expectation_maximisation(counts)[0])


def _all_spans(kind: str, model: dict, level: float) -> Column:
    """Base spans and accepted looser ones of a kind, by start."""
    good = [v for (k, v), p in sorted(model.items()) if k == kind and p >= level]
    extra = F.filter(f"loose_{kind}", lambda x: x["votes"].isin(good)) if good else F.filter(f"loose_{kind}", lambda x: F.lit(False))
    return F.array_sort(F.transform(F.concat(F.col(f"base_{kind}"), extra) if kind in KINDS else extra,
                                    lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def spans(cands: DataFrame, model: dict, level: float = 0.5) -> DataFrame:
    """(doc_id, base_<kind>, all_<kind>) with arrays of (start, end, ...)."""
    return cands.select("doc_id", *[f"base_{k}" for k in KINDS], *[_all_spans(k, model, level).alias(f"all_{k}") for k in ALL])


def find(docs: DataFrame, level: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spans`` of every document with a classifier fitted to these documents."""
    cands = written(candidates(docs, id_col, text_col), "pii-candidates")
    return spans(cands, fit(cands), level)


def joined(prefix: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of these kinds in their order, joined by commas."""
    one = lambda k: F.transform(F.col(f"{prefix}_{k}"), lambda x: F.concat(
        F.lit(k + ":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def redact(docs: DataFrame, level: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns as they are.

    Overlapping spans are replaced by the mark of the one that starts first. A null text stays null.
    """
    model = fit(written(candidates(docs, id_col, text_col), "pii-candidates"))
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").isNull().alias("__none")).alias("__row"),
                         F.col(f"`{text_col}`").alias("__text"))
    found = candidates(packed, "__row", "__text", keep_text=True).withColumnRenamed("doc_id", "__row")
    marked = lambda k: F.transform(_all_spans(k, model, level), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{k.upper()}>").alias("mark")))
    marks = F.array_sort(F.concat(*[marked(k) for k in ALL]))
    found = found.select("__row", "text", marks.alias("marks"))
    ends = F.transform("marks", lambda x: x["end"])

    def redacted(pieces: Column) -> Column:
        def kept(reach: Column):
            def piece(x: Column, i: Column) -> Column:
                return F.when(x["start"] >= F.get(reach, i), F.concat(_cut(pieces, F.get(reach, i), x["start"]), x["mark"])).otherwise("")
            return F.array_join(F.transform("marks", piece), "")
        return F.concat(_let(_before(ends, lambda a, b: F.greatest(a, b)), kept), _cut(pieces, F.array_max(ends), F.length("text")))

    text = F.when(F.size("marks") > 0, _let(_pieces(F.col("text")), redacted)).otherwise(F.when(~F.col("__row.__none"), F.col("text")))
    return found.select("__row", text.alias("__text")).select(
        *[F.col(f"__row.`{c}`") if c != text_col else F.col("__text").alias(text_col) for c in docs.columns])
