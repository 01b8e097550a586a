"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Generators propose spans. Four exact ones define the base spans; loose ones, tuned for recall, propose
spelled-out, differently separated or unmarked forms, overlapping with them. Boosted trees over format
and context features score the loose candidates. They learn from the text itself: base spans are rewritten to
the loose forms in their own context, which gives examples for them; examples against them are the same with a
check broken, and loose candidates that fail the check of their kind. Loose candidates that are not known
to be wrong teach nothing. All examples are learnt from, equal ones as one row with their number as its weight. A threshold
for each kind, calibrated on all examples scored by trees that have not seen them, selects what is added.

Patterns use possessive repeats and start at the borders of runs, so matching is linear in the
length of a text and needs no deep stack; the spans are those of the plain patterns.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from variscope.llm.common import carried
from variscope.session import cut

#: Kinds in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Kind and pattern of the exact generators.
BASE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: Kind and pattern of the loose generators.
LOOSE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: ?(?:@|\((?i:at)\)|\[(?i:at)\]) ?| (?i:at) (?=[A-Za-z0-9-]+ ?(?i:dot|\(dot|\[dot)\b))[A-Za-z0-9-]++(?: ?(?:\.|\((?i:dot)\)|\[(?i:dot)\]| (?i:dot) ) ?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-][0-9]{4}(?![0-9])"),
]
#: What every match of a kind holds.
SIGNS = {"email": r"@|(?i:\(at\)|\[at\]| at [a-z0-9-]+ ?[(\[]?dot\b)", "ip": r"[0-9]", "card": r"[0-9]{2}|[0-9][ -][0-9]", "phone": r"[0-9][ ().0-9/-]*[0-9]"}
CANDIDATES = "array<struct<kind:int,base:boolean,i:int,span:string,gap:int,left:string,right:string>>"
#: Words before a span that tell its kind.
CUES = [r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|paid|account", r"phone|tel|call|fax|mobile"]
FEATURES = ["kind", "length", "digits", "letters", "groups", "longest", "first", "valid", "small", "cue", "before", "after", "upper"]
#: Parts into which examples are dealt, each scored by trees that learn from the others.
PARTS = 4
#: What at sign and dot of an address, dots of an IP and separators of card and phone digits are rewritten to for the examples.
AT_DOT = [(" (at) ", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)")]
IP_DOT = ["[.]", "(.)", " . "]
CARD_MARK = [".", "/", "_", ""]
PHONE_FORM = ["(%s) %s-%s", "%s-%s-%s", "%s.%s.%s", "%s %s %s"]


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _valid(kind: Column, span: Column) -> Column:
    """What a base match must meet beyond its pattern."""
    digits = _digits(span)
    n = F.length(digits)
    parts = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == 1, small).when(kind == 2, n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, n.between(9, 15)).otherwise(F.lit(True))
    )


def _proposed(text: Column, pattern: str, sign: str, kind: str, base: bool) -> Column:
    """Array of a generator's matches, each with the text between it and the one before.

    Only texts that hold ``sign``, without which nothing can match, are searched. The one-row array binds
    gaps and matches to a name, so that each is computed once.
    """
    bound = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans")))
    found = F.transform(bound, lambda x: F.transform(x["spans"], lambda span, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("i"), span.alias("span"),
        F.length(F.get(x["gaps"], i)).alias("gap"), F.right(F.get(x["gaps"], i), F.lit(24)).alias("left"), F.left(F.get(x["gaps"], i + 1), F.lit(8)).alias("right"))))
    return F.when(text.rlike(sign), F.element_at(found, 1))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``df`` but the text, with ``row`` and one row for each candidate, or one with nulls.

    Adds kind, base (an exact match that holds), loose (from a loose generator), start, end (code
    points), same (overlaps a base span of its kind), any (of some kind) and the features. ``row`` tells repeated rows apart.
    """
    others = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    generators = [_proposed(body, p, SIGNS[k], k, True) for k, p in BASE] + [_proposed(body, p, SIGNS[k], k, False) for k, p in LOOSE]
    generators = [F.coalesce(g, F.array().cast(CANDIDATES)) for g in generators]
    rows = df.withColumn("row", F.monotonically_increasing_id()).select("row", *others, F.explode_outer(F.flatten(F.array(*generators))).alias("c"))
    rows = rows.select("row", *others, "c.*").repartition("row")
    run = Window.partitionBy("row", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(run)).withColumn("start", F.col("end") - F.length("span"))
    # Matches that fail stay as rows of neither sort, so that their document keeps a row.
    placed = placed.withColumn("loose", ~F.col("base")).withColumn("base", F.col("base") & _valid(F.col("kind"), F.col("span")))

    def overlaps(window) -> Column:
        upto, beyond = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
        earlier = F.max(F.when(F.col("base"), F.col("end"))).over(upto)
        later = F.min(F.when(F.col("base"), F.col("start"))).over(beyond)
        return F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))

    same = Window.partitionBy("row", "kind").orderBy("start", "base", "end")
    every = Window.partitionBy("row").orderBy("start", "base", "end", "kind")
    flagged = placed.withColumn("same", overlaps(same)).withColumn("any", overlaps(every))
    return flagged.select(
        "row", *others, *[F.col(c).alias(c) for c in ("kind", "base", "loose", "start", "end", "same", "any", "span", "left", "right")],
        *[v.alias(f"f_{n}") for n, v in _features().items()])


def _features() -> dict[str, Column]:
    """Format and context of a candidate (kind, span, left, right), whatever marks it is written with."""
    span, digits = F.col("span"), _digits(F.col("span"))
    pieces = F.filter(F.split(span, "[^A-Za-z0-9]+"), lambda p: p != "")
    plain = F.regexp_replace(span, r" ?(?:[(\[](?:(?i:dot)|\.)[)\]]|(?i:\bdot\b)|\.) ?", ".")
    features = {
        "kind": F.col("kind"), "length": F.length(span), "digits": F.length(digits), "letters": F.length(F.regexp_replace(span, "[^A-Za-z]", "")),
        "groups": F.size(pieces), "longest": F.array_max(F.transform(pieces, F.length)), "first": F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        "valid": F.when(F.col("kind") == 0, plain.rlike(r"\.[A-Za-z]{2,24}$")).when(F.col("kind") == 1, _valid(F.lit(1), plain))
        .when(F.col("kind") == 2, _valid(F.lit(2), span)).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")).cast("int"),
        "small": F.forall(pieces, lambda p: F.length(p) <= 3).cast("int"),
        "cue": reduce(lambda a, k: a.when((F.col("kind") == k) & F.lower("left").rlike(CUES[k]), 1), range(4), F.when(F.lit(False), 0)).otherwise(0),
        "before": F.when(F.col("left").rlike("[A-Za-z0-9]$"), 2).when(F.col("left").rlike("[^ \n]$"), 1).otherwise(0),
        "after": F.when(F.col("right").rlike("^[A-Za-z0-9]"), 2).when(F.col("right").rlike("^[^ \n]"), 1).otherwise(0),
        "upper": F.length(F.regexp_replace(span, "[^A-Z]", "")),
    }
    return {n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in features.items()}


def _rewritten() -> Column:
    """Array of (span, label): a base span in the loose forms of its kind, and the same with a check broken."""
    span, digits = F.col("span"), _digits(F.col("span"))
    made = lambda text, label: F.struct(text.alias("span"), F.lit(label).alias("label"))
    user, host = F.substring_index(span, "@", 1), F.substring_index(span, "@", -1)
    odd = F.concat(F.substring_index(host, ".", 1), F.lit(".4"))
    emails = [made(F.concat(user, F.lit(at), F.replace(h, F.lit("."), F.lit(dot))), label) for at, dot in AT_DOT for h, label in ((host, 1.0), (odd, 0.0))]
    large = F.concat(F.lit("9"), F.lpad(F.substring_index(span, ".", 1), 2, "0"), F.lit("."), F.substring_index(span, ".", -3))
    ips = [made(F.replace(x, F.lit("."), F.lit(dot)), label) for dot in IP_DOT for x, label in ((span, 1.0), (large, 0.0))]
    last = F.right(digits, F.lit(1)).try_cast("int")
    failing = F.concat(F.substring(digits, 1, 11), F.substring(digits, F.lit(12), F.length(digits) - 12), F.pmod(last + 1, F.lit(10)).cast("string"))
    cards = [made(F.concat_ws(mark, F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4), F.substring(d, 13, 7)), label)
             for mark in CARD_MARK for d, label in ((digits, 1.0), (failing, 0.0))]
    ten = F.right(digits, F.lit(10))
    phones = [made(F.format_string(form, F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)), label)
              for form in PHONE_FORM for d, label in ((ten, 1.0), (F.concat(F.lit("0"), F.substring(ten, 2, 9)), 0.0))]
    whole = (F.length(digits) >= 13) | (F.col("kind") != 2)
    forms = F.when(F.col("kind") == 0, F.array(*emails)).when(F.col("kind") == 1, F.array(*ips)).when(F.col("kind") == 2, F.array(*cards)).otherwise(F.array(*phones))
    return F.when(whole & ((F.col("kind") != 3) | digits.rlike("[2-9][0-9]{2}[2-9][0-9]{6}$")), forms)


def examples(found: DataFrame) -> DataFrame:
    """(kind, label, part, features, n) that the trees learn from; ``n`` examples are equal in all the rest.

    All base spans, rewritten to the loose forms (label 1) and with a check broken (0); and all loose candidates that overlap no
    base span and fail the check of their kind (0). ``part`` deals them out by the span they come from and the text around it,
    so that copies stay together. Equal spans in equal surroundings are rewritten once.
    """
    where, inputs = ["kind", "span", "left", "right"], [f"f_{n}" for n in FEATURES]
    part = F.pmod(F.xxhash64(*where), F.lit(PARTS)).alias("part")
    base = found.where("base").groupBy(*where).agg(F.count("*").alias("n"))
    made = base.select("kind", "left", "right", "n", part, F.explode(_rewritten()).alias("x")).select("kind", "left", "right", "n", "part", "x.span", "x.label")
    made = made.select("kind", "label", "part", *[v.alias(f"f_{n}") for n, v in _features().items()], "n")
    wrong = found.where("loose and not any and f_valid = 0").select("kind", F.lit(0.0).alias("label"), part, *inputs, F.lit(1).cast("long").alias("n"))
    return made.unionByName(wrong).groupBy("kind", "label", "part", *inputs).agg(F.sum("n").cast("double").alias("n"))


def select_added(found: DataFrame, *, precision: float = 0.98, trees: int = 20, depth: int = 3) -> DataFrame:
    """(row, kind, start, end) of loose candidates that the boosted trees select.

    The trees learn from all examples. For each kind, the lowest threshold at which ``precision`` of the examples above are right
    is set on all examples too, each scored by trees that learn from the other parts. A kind without base spans adds nothing.
    """
    inputs = [f"f_{n}" for n in FEATURES]
    wanted = found.where("loose and not any")
    nothing = wanted.where(F.lit(False)).select("row", "kind", "start", "end")
    if wanted.isEmpty():
        return nothing
    drawn = cut(examples(found))
    dealt = drawn.groupBy("part", "label").agg(F.count("*").alias("rows")).collect()  # two rows for each part
    held = {r["part"] for r in dealt}
    # Parts whose examples can be scored: the others have both labels.
    parts = sorted(p for p in held if len({r["label"] for r in dealt if r["part"] != p}) == 2)
    if not parts:
        return nothing
    vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    # Spark looks for splits in a sample of rows unless there are no more of them than the square of the bins.
    bins = min(46_340, max(32, isqrt(sum(r["rows"] for r in dealt)) + 1))
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="n", maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=7, checkpointInterval=-1)

    def fitted(df: DataFrame) -> GBTClassificationModel:
        return learner.fit(vectors.transform(df).select("features", "label", "n"))

    def scored(df: DataFrame, model: GBTClassificationModel) -> DataFrame:
        return model.transform(vectors.transform(df)).withColumn("p", vector_to_array("probability")[1])

    apart = reduce(DataFrame.unionByName, [scored(drawn.where(F.col("part") == p), fitted(drawn.where(F.col("part") != p))).select("kind", "label", "n", "p") for p in parts])
    steps = apart.groupBy("kind", F.floor(F.col("p") * 100).alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).collect()  # 404 rows at most
    least = {}
    for kind in range(len(KINDS)):
        hits = n = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            hits, n = hits + r["hits"], n + r["n"]
            if hits < precision * n:
                break
            least[kind] = r["step"] / 100
    if not least:
        return nothing
    enough = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("p") >= max(t, 0.5)) for k, t in least.items()])
    return scored(wanted, fitted(drawn)).where(enough).select("row", "kind", "start", "end")


def find_personal(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row for each row of ``df``: its columns but the text, ``base`` and ``spans``.

    Both are arrays of (start, kind, end), in order; ``spans`` has the base ones and those the
    trees add. Positions count code points, the end is exclusive. Null and empty texts have
    none. Repeated rows come as often as in ``df``.
    """
    others = [c for c in df.columns if c != text]
    found = cut(candidates(df, text))
    added = select_added(found, **options)
    span = F.struct("start", "kind", "end")
    kept = found.select("row", *others, F.when(F.col("base"), span).alias("b"), F.when(F.col("base"), span).alias("s"))
    more = added.select("row", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in others], F.lit(None).cast(kept.schema["b"].dataType).alias("b"), span.alias("s"))
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in others]
    return kept.unionByName(more).groupBy("row").agg(*firsts, F.sort_array(F.collect_list("b")).alias("base"), F.sort_array(F.collect_list("s")).alias("spans")).drop("row")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    Equal texts get equal spans. Null texts stay null.
    """
    columns = docs.columns
    digest = F.md5(F.col(text).cast("binary"))
    texts = docs.where(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("text"))
    spans = find_personal(texts, **options).where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    rows = carried(docs, _text=F.col(text), _digest=digest).join(spans, F.col("_digest") == F.col("digest"), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        more = F.array(F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("_text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    clean = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(done)
    return rows.select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`") for c in columns])
