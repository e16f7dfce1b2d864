"""Personal data: fixed patterns, and further spans that boosted trees select from candidates.

All of it is DataFrame expressions. Spans are found by splitting a text at a pattern: the lengths of the pieces and of the
matches between them give every place. Patterns run on copies of the text in which single characters are exchanged, so
that character classes suffice: no repeated groups, whose matching would overflow the stack on long runs.

Candidates come from wider patterns (obfuscated addresses, numbers with any separators). What is true is learnt from the fixed
spans: each stands in its own context, as it is and rewritten into the forms that people hide it in (an address with "(at)" or
blanks, a number without its plus). Negatives are candidates that fail their kind's check or are glued to a letter or digit,
and those that look like no known span in any form; a candidate that looks like one is unknown, and not learnt from. Training
counts the few hundred different feature vectors over all documents; the trees are fitted on those counts, and calibrated on
the other half of the documents: for each kind the smallest score whose share of true spans reaches `precision`. A new span
must also pass its kind's own check (letters at an address's end, Luhn, parts to 255, number of digits), be glued to nothing and
touch no fixed span; of new spans that overlap the first stays.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.llm.common import text_of

# Kinds in the order of the contract.
KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = "A-Za-z0-9._%+-"
_SPAN = "array<struct<at:int,kind:int,end:int,hit:string>>"
_NONE = f"CAST(array() AS {_SPAN})"


def _running(sizes: Column) -> Column:
    """Ends of pieces of the given lengths: sums up to each, in blocks of the root of their number, so that long arrays stay cheap."""
    block = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda i: F.slice(sizes, i * block + 1, block))
    zero = F.lit(0)
    sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
    start = F.aggregate(sums, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def within(p: Column, base: Column) -> Column:
        grown = F.aggregate(p, F.array(base), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return F.slice(grown, 2, F.greatest(F.size(grown) - 1, F.lit(0)))

    return F.flatten(F.zip_with(parts, F.slice(start, 1, F.size(parts)), within))


def _matches(df: DataFrame, text: str, pattern: str, kind: int, when: Column, out: str) -> DataFrame:
    """Adds `out`: the pattern's leftmost matches as (at, kind, end, hit), in code points."""
    df = df.withColumn("_hit", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.coalesce(F.size("_hit"), F.lit(0)) > 0
    df = df.withColumn("_gap", F.when(some, F.split(text, pattern, -1)))
    # gap, match, gap, match: the end of each
    sizes = F.when(some, F.flatten(F.zip_with(F.slice("_gap", F.lit(1), F.size("_hit")), "_hit", lambda g, h: F.array(F.length(g), F.length(h)))))
    df = df.withColumn("_size", sizes)
    df = df.withColumn("_end", F.when(some, _running(F.col("_size"))))
    spans = F.transform("_hit", lambda h, i: F.struct(F.get("_end", 2 * i).alias("at"), F.lit(kind).alias("kind"), F.get("_end", 2 * i + 1).alias("end"), h.alias("hit")))
    return df.withColumn(out, F.coalesce(F.when(some, spans), F.expr(_NONE))).drop("_hit", "_gap", "_size", "_end")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _is_ip(x: Column) -> Column:
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(x, "[.]", -1), small)


def _is_card(x: Column) -> Column:
    d = _digits(x)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def fixed_spans(df: DataFrame) -> DataFrame:
    """Adds `base`: the spans of the fixed patterns in `body`, by place, then kind."""
    has = lambda s: F.contains("body", F.lit(s))
    # a dot that no domain can hold becomes a sign that only local parts hold
    df = df.withColumn("_mail", F.when(has("@"), F.regexp_replace("body", r"[.](?![A-Za-z0-9-])", "_")))
    df = _matches(df, "_mail", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++[.][A-Za-z0-9.-]++", EMAIL, F.col("_mail").isNotNull(), "_email")
    digits = F.col("body").rlike("[0-9]")
    df = _matches(df, "body", r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++", IP, F.col("body").rlike(r"[0-9][.][0-9]"), "_ip")
    # a separator that isn't between two digits ends a number
    df = df.withColumn("_line", F.when(digits, F.regexp_replace("body", r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "x")))
    df = _matches(df, "_line", r"[0-9][0-9\x20-]++", CARD, F.col("_line").rlike("[0-9][0-9 -]{11}"), "_card")
    df = _matches(df, "body", r"\+[0-9][\x20().0-9-]+[0-9]", PHONE, has("+"), "_phone")
    sound = lambda c, check: F.filter(c, lambda s: check(s["hit"]))
    kept = [F.col("_email"), sound("_ip", _is_ip), sound("_card", _is_card), sound("_phone", _is_phone)]
    return df.withColumn("base", F.array_sort(F.concat(*kept))).drop("_mail", "_line", "_email", "_ip", "_card", "_phone")


# ---- candidates and their features

_ADDRESS = r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]\x20?at\x20?[)\]])\x20?[A-Za-z0-9-]{1,63}(?:(?:[.]|\x20?[(\[]\x20?dot\x20?[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,5}"
_NUMBER = r"[+(]{0,2}[0-9][0-9\x20()./-]{6,40}[0-9]"
FEATURES = ["digits", "longest", "marks", "brackets", "dots", "before", "after", "word"]


def _kind_of_number(hit: Column) -> Column:
    long = F.when(hit.startswith("+"), PHONE).otherwise(CARD)
    return F.when(F.size(F.split(hit, "[.]", -1)) == 4, IP).when(F.length(_digits(hit)) >= 12, long).otherwise(PHONE)


def _candidates(df: DataFrame) -> DataFrame:
    """Adds `cand`: overlapping wider spans."""
    body = F.col("body")
    df = _matches(df, "body", _ADDRESS, EMAIL, F.contains(body, F.lit("@")) | body.rlike(r"[(\[]\x20?at\x20?[)\]]"), "_a")
    df = _matches(df, "body", _NUMBER, PHONE, body.rlike("[0-9][0-9 ()./-]{7}"), "_n")
    named = F.transform("_n", lambda s: F.struct(s["at"].alias("at"), _kind_of_number(s["hit"]).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")))
    return df.withColumn("cand", F.concat("_a", named)).drop("_a", "_n")


# forms of "@" and of the dots after it
HIDDEN = [(" (at) ", " (dot) "), ("(at)", "(dot)"), (" (at) ", "."), ("(at)", "."), (" @ ", ".")]


def _rewritten(base: Column) -> Column:
    """The fixed spans in other forms, at their places."""

    def forms(s: Column) -> Column:
        local, host = F.substring_index(s["hit"], "@", 1), F.substring_index(s["hit"], "@", -1)
        mails = [F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in HIDDEN]
        # as a candidate is cut: it starts with a digit or a bracket and ends with a digit
        plain = F.regexp_replace(s["hit"], r"^\+", "")
        made = lambda hit, kind: F.struct(s["at"].alias("at"), kind.alias("kind"), s["end"].alias("end"), hit.alias("hit"))
        return F.when(s["kind"] == EMAIL, F.array(*[made(m, F.lit(EMAIL)) for m in mails])).when(s["kind"] == PHONE, F.array(made(plain, _kind_of_number(plain))))

    return F.filter(F.flatten(F.transform(F.filter(base, lambda s: s["kind"].isin(EMAIL, PHONE)), forms)), lambda s: _sound(s))


def _sound(s: Column) -> Column:
    """Whether a span passes its kind's check."""
    mail = s["hit"].rlike("[A-Za-z]{2}$")
    return F.when(s["kind"] == EMAIL, mail).when(s["kind"] == IP, _is_ip(s["hit"])).when(s["kind"] == CARD, _is_card(s["hit"])).otherwise(_is_phone(s["hit"]))


def _side(c: Column) -> Column:
    """Kind of a neighbouring character: none, white space, letter, digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _features(body: Column, s: Column) -> Column:
    """Format and context as small numbers; what the fixed patterns test (a plus sign, checksums) isn't among them."""
    hit = s["hit"]
    before = F.when(s["at"] > 0, F.substring(body, s["at"], F.lit(1))).otherwise("")
    lead = F.when(s["at"] > 0, F.substring(body, F.greatest(s["at"] - 11, F.lit(1)), F.least(s["at"], F.lit(12)))).otherwise("")
    number = lambda x, most: F.least(x, F.lit(most)).cast("int")
    few = lambda x, most: F.when(s["kind"] == EMAIL, number(x, 1)).otherwise(number(x, most))  # noqa: E731  an address has digits or none
    return F.struct(
        s["kind"].alias("kind"), few(F.length(_digits(hit)), 20).alias("digits"),
        few(F.array_max(F.transform(F.split(hit, "[^0-9]+", -1), F.length)), 17).alias("longest"),
        number(F.length(F.regexp_replace(hit, r"[^\x20/-]", "")), 6).alias("marks"), hit.rlike(r"[(\[]").cast("int").alias("brackets"),
        number(F.length(F.regexp_replace(hit, "[^.]", "")), 5).alias("dots"), _side(before).alias("before"),
        _side(F.substring(body, s["end"] + 1, F.lit(1))).alias("after"), lead.rlike(r"\p{L}\s$").cast("int").alias("word"),
    )


@dataclass(frozen=True)
class Tree:
    """Up to two splits: (feature, at most) -> two (feature, at most, low, high)."""

    feature: str
    limit: int
    sides: tuple[tuple[str, int, float, float], tuple[str, int, float, float]]

    def column(self, f: Column) -> Column:
        (a, x, lo1, hi1), (b, y, lo2, hi2) = self.sides
        return F.when(f[self.feature] <= self.limit, F.when(f[a] <= x, lo1).otherwise(hi1)).otherwise(F.when(f[b] <= y, lo2).otherwise(hi2))


@dataclass(frozen=True)
class Model:
    trees: list[Tree]
    threshold: dict[int, float]  # by kind; a kind without one gets no new spans

    def score(self, f: Column) -> Column:
        return sum((t.column(f) for t in self.trees), F.lit(0.0))


def boosted(rows: list[dict], rounds: int = 20, rate: float = 0.4, precision: float = 0.98, least: int = 20) -> Model:
    """Fit on rows with "fold" 0, calibrate on fold 1. rows: features, n (spans), good (true ones), fold: counts, so their number is bounded."""
    import numpy as np

    names = ["kind", *FEATURES]
    x = np.array([[r[f] for f in names] for r in rows], np.int64).reshape(-1, len(names))
    n, good, fold = (np.array([r[c] for r in rows], float) for c in ("n", "good", "fold"))
    score, trees = np.zeros(len(rows)), []

    def best(mask: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
        top = (-1.0, 0, int(x[:, 0].max()))
        for j in range(len(names)):
            for limit in np.unique(x[mask, j])[:-1]:
                low = mask & (x[:, j] <= limit)
                high = mask & ~low
                gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (low, high))
                top = max(top, (gain, j, int(limit)))
        return top

    train = fold == 0
    for _ in range(rounds if train.any() else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = good - n * p, n * p * (1 - p)
        leaf = lambda m: float(rate * grad[m & train].sum() / (hess[m & train].sum() + 1))  # noqa: B023, E731
        _, j, limit = best(train, grad, hess)
        sides, add = [], np.zeros(len(rows))
        for side in (x[:, j] <= limit, x[:, j] > limit):
            _, k, cut = best(train & side, grad, hess) if (train & side).any() else (0, j, limit)
            low, high = side & (x[:, k] <= cut), side & (x[:, k] > cut)
            sides.append((names[k], cut, leaf(low), leaf(high)))
            add[low], add[high] = sides[-1][2], sides[-1][3]
        score += add
        trees.append(Tree(names[j], limit, tuple(sides)))
    threshold = {}
    for kind in range(len(KINDS)):
        own = np.flatnonzero((fold == 1) & (x[:, 0] == kind))
        own = own[np.argsort(-score[own])]
        share = np.cumsum(good[own]) / np.maximum(np.cumsum(n[own]), 1)
        enough = np.flatnonzero((share >= precision) & (np.cumsum(n[own]) >= least))
        if len(enough):
            threshold[kind] = float(score[own[enough[-1]]])
    return Model(trees, threshold)


GOOD, BAD, UNKNOWN = range(3)


def _true(s: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["at"] <= s["at"] + 1) & (b["end"] >= s["end"]) & (b["kind"] == s["kind"]))


def _glued(f: Column) -> Column:
    return f["before"].isin(2, 3) | f["after"].isin(2, 3)


def examples(rows: list[dict]) -> list[dict]:
    """Counts to learn from, of counts by fold, vector and label: the unknown are negative where no known span looks alike."""
    names = ["kind", *FEATURES]
    like = {tuple(r[f] for f in names) for r in rows if r["label"] == GOOD}
    out: dict[tuple, dict] = {}
    for r in rows:
        vector = tuple(r[f] for f in names)
        if r["label"] == UNKNOWN and vector in like:
            continue
        row = out.setdefault((r["fold"], vector), dict(zip(names, vector, strict=True)) | {"fold": r["fold"], "n": 0, "good": 0})
        row["n"] += r["n"]
        row["good"] += r["n"] if r["label"] == GOOD else 0
    return [out[k] for k in sorted(out)]


def train(docs: DataFrame, rounds: int = 20, precision: float = 0.98) -> Model:
    """Counts of feature vectors over all documents; they are few: features are small numbers, most of them tied to the format."""
    rows = _candidates(fixed_spans(docs.select("doc_id", text_of().alias("body"))))
    body = F.col("body")

    def labelled(s: Column) -> Column:
        f = _features(body, s)
        return F.struct(f.alias("f"), F.when(_true(s, F.col("base")), GOOD).when(~_sound(s) | _glued(f), BAD).otherwise(UNKNOWN).alias("label"))

    known = F.transform(_rewritten(F.col("base")), lambda s: F.struct(_features(body, s).alias("f"), F.lit(GOOD).alias("label")))
    found = F.concat(F.transform("cand", labelled), known)
    flat = rows.select((F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 2).alias("fold"), F.explode_outer(found).alias("c")).filter("c is not null")
    counts = flat.groupBy("fold", "c.f", "c.label").agg(F.count(F.lit(1)).alias("n"))
    return boosted(examples([r.asDict() for r in counts.select("fold", "f.*", "label", "n").collect()]), rounds, precision=precision)


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, rounds: int = 20, precision: float = 0.98) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts are of the fixed spans; `spans` also has those that the trees add. A null text is empty. Places count code
    points. Without candidates there is nothing to learn and nothing is added. Other columns are ignored.
    """
    model = train(docs, rounds, precision)
    df = fixed_spans(docs.select("doc_id", text_of().alias("body")))
    df = _candidates(df)
    if model.threshold:
        # features once per candidate, in a column of their own
        span = lambda s, *more: F.struct(*[s[c].alias(c) for c in ("at", "kind", "end", "hit")], *more)
        df = df.withColumn("told", F.when(F.size("cand") > 0, F.transform("cand", lambda s: span(s, _features(F.col("body"), s).alias("f")))))
        least = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(t)) for k, t in model.threshold.items()])
        free = lambda s: ~F.exists("base", lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"]))
        fit = lambda s: ~_glued(s["f"]) & free(s) & (model.score(s["f"]) >= least(s)) & _sound(s)
        df = df.withColumn("more", F.coalesce(F.array_sort(F.transform(F.filter("told", fit), lambda s: span(s))), F.expr(_NONE)))
        # matches of one pattern don't overlap, so a span can only overlap the first of the other pattern's before it
        overlaps = lambda s: F.exists("more", lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"]) & ((b["at"] < s["at"]) | ((b["at"] == s["at"]) & (b["kind"] < s["kind"]))))
        df = df.withColumn("more", F.filter("more", lambda s: ~overlaps(s)))
    else:
        df = df.withColumn("more", F.expr(_NONE))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "more"))
    return df.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(every).alias("spans"))
