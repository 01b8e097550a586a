"""Projections of source lines and preprocessor expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Directive words of the C preprocessor that carry structure.
OPENERS = ("if", "ifdef", "ifndef")
CONDITIONAL = (*OPENERS, "elif", "else", "endif")
DIRECTIVE = r"^\s*#\s*(ifdef|ifndef|if|elif|else|endif|define|undef|include)\b\s*(.*)$"
DROPPED = r"^\s*#\s*(error|warning|assert|include_next)\b"
SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*[.]*"
SPACE_DEFAULT = "^CONFIG_[^ ]+$"


def directives(lines: DataFrame) -> DataFrame:
    """Directive lines with ``kind`` and ``arg``; other lines are dropped."""
    return lines.filter(F.col("txt").rlike(DIRECTIVE)).select(
        *[c for c in lines.columns if c != "txt"],
        F.regexp_extract("txt", DIRECTIVE, 1).alias("kind"),
        F.trim(F.regexp_extract("txt", DIRECTIVE, 2)).alias("arg"),
    )


def drop_statements(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("txt").rlike(DROPPED))


def normalize_define_zero(lines: DataFrame) -> DataFrame:
    """``#define X 0`` means the same as ``#undef X`` for block conditions."""
    return lines.withColumn(
        "txt", F.regexp_replace("txt", r"^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)\s+0\s*$", "#undef $1")
    )


def normalize_is_enabled(expr: Column) -> Column:
    """IS_BUILTIN, IS_MODULE and IS_ENABLED spelled with ``defined``."""
    arg = r"\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)"
    expr = F.regexp_replace(expr, r"\bIS_BUILTIN\s*" + arg, "defined($1)")
    expr = F.regexp_replace(expr, r"\bIS_MODULE\s*" + arg, "defined($1_MODULE)")
    return F.regexp_replace(expr, r"\bIS_ENABLED\s*" + arg, "(defined($1) || defined($1_MODULE))")


def expression(kind: Column, arg: Column) -> Column:
    """Condition text of a block opener; an ``else`` has none."""
    return (
        F.when(kind == "else", F.lit(""))
        .when(kind == "ifndef", F.concat(F.lit("! "), arg))
        .otherwise(F.trim(F.regexp_replace(arg, "defined", "")))
    )


def block_expression(dirs: DataFrame) -> DataFrame:
    starts = [k for k in CONDITIONAL if k != "endif"]
    return dirs.filter(F.col("kind").isin(starts)).withColumn("expr", expression(F.col("kind"), F.col("arg")))


def normalize_enable_macros(lines: DataFrame) -> DataFrame:
    """``ENABLE_X`` in ``#if``/``#elif`` lines becomes ``defined CONFIG_X``."""
    txt = F.replace("txt", F.lit("defined ENABLE_"), F.lit("defined CONFIG_"))
    guarded = txt.rlike(r"^#\s*(el)?if[\s()!]+ENABLE_\S")
    inner = txt.rlike(r"[A-Z]+_ENABLE_[A-Z0-9^\s|&_]+")  # a name that contains the word itself
    first = F.regexp_replace(txt, r"^(.*?)ENABLE_", "$1defined CONFIG_")
    every = F.replace(txt, F.lit("ENABLE_"), F.lit("defined CONFIG_"))
    return lines.withColumn("txt", F.when(guarded & inner, first).when(guarded, every).otherwise(txt))


def symbols_of(expr: Column) -> Column:
    """Distinct symbol names of an expression (trailing dots kept)."""
    found = F.regexp_extract_all(expr, F.lit(f"({SYMBOL})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: s != "defined"))


def expr_symbols(exprs: DataFrame, column: str = "expr") -> DataFrame:
    """One row per symbol of an expression."""
    return exprs.select(
        *[c for c in exprs.columns if c != column], F.explode(symbols_of(F.col(column))).alias("symbol")
    )


def item_name(symbol: Column) -> tuple[Column, Column]:
    """(name without rewrite dots and ``_MODULE``, number of dots); null if no symbol."""
    pattern = r"^([A-Za-z_][0-9A-Za-z_]*?)([.]*)(_MODULE)?$"
    name = F.nullif(F.regexp_extract(symbol, pattern, 1), F.lit(""))
    return name, F.length(F.regexp_extract(symbol, pattern, 2))


def normal_path(path: Column) -> Column:
    """Path without ``.``, empty and ``..`` parts."""
    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(F.rtrim(path), "/"), F.expr("cast(array() as array<string>)"), step)
    clean = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.concat_ws("/", parts))
    return F.when(clean == "", ".").otherwise(clean)


def file_variable(path: Column) -> Column:
    cut_dot = F.regexp_replace(path, r"^\./", "")
    return F.concat(F.lit("FILE_"), F.translate(cut_dot, "/-+:,", "_____"))


def arch_of(path: Column) -> Column:
    """Architecture named by an ``arch/<name>/`` directory, else null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)arch/([A-Za-z0-9]+)/", 1), F.lit(""))


def config_like(symbol: Column) -> Column:
    return F.when(symbol.rlike("^CONFIG_.+"), "CONFIG_LIKE").otherwise("NOT_CONFIG_LIKE")


# Shapes of plain conditions that become literal rows exactly; anything else is counted
# as unsupported.
_LIT = r"!?(?:[A-Za-z_][A-Za-z0-9_]*[.]*|[01])"
_OR = rf"{_LIT}(\|\|{_LIT})*"
_AND = rf"{_LIT}(&&{_LIT})*"
_GROUP = rf"\({_OR}\)"
SHAPE_OR = rf"^{_OR}$"
SHAPE_AND = rf"^({_LIT}|{_GROUP})(&&({_LIT}|{_GROUP}))*$"
_CLOSED = r"(?<![A-Za-z0-9_.])"  # a bracket that is no macro's


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it.

    A column named twice is an expression written twice, and so on through each function it passes.
    """
    return F.transform(F.array(value), use)[0]


def _loose_brackets(expr: Column) -> Column:
    """Drop brackets around one literal or group of one sort, and double negations."""
    def loose(e):
        for _ in range(3):
            e = F.regexp_replace(e, rf"{_CLOSED}\(({_LIT}|\([^()]*\))\)", "$1")
            e = F.replace(e, F.lit("!!"), F.lit(""))
        return F.regexp_replace(e, r"^\(([^()]*)\)$", "$1")

    return once(expr, lambda e: F.when(F.contains(e, F.lit("(")) | F.contains(e, F.lit("!!")), loose(e)).otherwise(e))


def _turned(group: Column) -> Column:
    """A negated flat group with the negation taken inside; others as they are."""
    turn = lambda inner, sep, joint: F.array_join(F.transform(
        F.split(inner, sep), lambda l: F.when(l.startswith("!"), F.substring(l, 2, 1 << 20)).otherwise(F.concat(F.lit("!"), l))), joint)
    return once(F.regexp_extract(group, r"^!\((.*)\)$", 1), lambda inner: (
        F.when(~F.contains(inner, F.lit("&&")), turn(inner, r"\|\|", "&&"))
        .when(~F.contains(inner, F.lit("||")), F.concat(F.lit("("), turn(inner, "&&", "||"), F.lit(")"))).otherwise(group)
    ))


def plain_condition(expr: Column) -> Column:
    """A condition without needless blanks and brackets, negations only at literals.

    Brackets of a macro call stay, and so does what mixes ``&&`` and ``||`` in a group.
    """
    def inward(bare):
        negated = F.regexp_extract_all(bare, F.lit(r"(!\([^()]*\))"), F.lit(1))
        turned = F.aggregate(negated, bare, lambda done, g: F.replace(done, g, _turned(g)))
        return _loose_brackets(F.when(F.contains(bare, F.lit("!(")), turned).otherwise(bare))

    def flat(moved):
        call = moved.rlike(r"[A-Za-z0-9_.]\(") | F.contains(moved, F.lit("!("))
        paired = F.length(F.replace(moved, F.lit("("), F.lit(""))) == F.length(F.replace(moved, F.lit(")"), F.lit("")))
        one_sort = paired & ~call & (~F.contains(moved, F.lit("&&")) | ~F.contains(moved, F.lit("||")))
        bracket = F.contains(moved, F.lit("(")) | F.contains(moved, F.lit(")"))
        return F.when(bracket & one_sort, F.regexp_replace(moved, "[()]", "")).otherwise(moved)

    bare = _loose_brackets(F.trim(F.regexp_replace(expr, r"\s*(\(|\)|!|&&|\|\|)\s*", "$1")))
    return once(once(bare, inward), flat)


def literal_groups(expr: Column) -> Column:
    """array<array<struct<symbol, positive>>>: a conjunction of disjunctions, or null.

    Constants are worked in: a condition that always holds has no groups, one that never does an empty one.
    """
    return once(plain_condition(expr), _groups)


def supported(expr: Column) -> Column:
    """Whether a condition has ``literal_groups``."""
    return once(plain_condition(expr), _in_shape)


def _in_shape(plain: Column) -> Column:
    return plain.rlike(SHAPE_OR) | plain.rlike(SHAPE_AND)


def _groups(plain: Column) -> Column:
    def literal(text):
        return F.struct(F.regexp_replace(text, "^!", "").alias("symbol"), (~text.startswith("!")).alias("positive"))

    def constant(l, value):
        return ((l["symbol"] == "1") & (l["positive"] == value)) | ((l["symbol"] == "0") & (l["positive"] != value))

    groups = F.transform(F.split(F.regexp_replace(plain, "[()]", ""), "&&"), lambda g: F.transform(F.split(g, r"\|\|"), literal))
    left = F.filter(groups, lambda g: ~F.exists(g, lambda l: constant(l, True)))
    left = F.transform(left, lambda g: F.filter(g, lambda l: ~constant(l, False)))
    return F.when(_in_shape(plain), left)


def supported_conditions(exprs: DataFrame, column: str = "expr") -> DataFrame:
    """``plain`` of the conditions with ``literal_groups`` and of empty ones, in place of ``column``; other rows are dropped."""
    kept = once(plain_condition(F.col(column)), lambda p: F.when((F.col(column) == "") | _in_shape(p), F.array(p)))
    return exprs.select(*[c for c in exprs.columns if c != column], F.explode(kept).alias("plain"))


def expr_literals(exprs: DataFrame, column: str = "expr") -> DataFrame:
    """Literal rows (grp, symbol, positive, supported); one null row when unsupported.

    A condition that always holds has one supported row without group; one that never does, rows without symbol.
    """
    keep = [c for c in exprs.columns if c != column]
    parsed = exprs.withColumn("_groups", literal_groups(F.col(column)))
    return (
        parsed.select(*keep, F.col("_groups").isNotNull().alias("supported"), F.posexplode_outer("_groups").alias("grp", "_g"))
        .select(*keep, "supported", "grp", F.explode_outer("_g").alias("_l"))
        .select(*keep, "supported", F.col("grp").cast("bigint").alias("grp"), "_l.symbol", "_l.positive")
    )


def defect_name(path: Column, block: Column, kind: Column, arch: Column, is_global: Column, suffix: Column) -> Column:
    """File name of a defect report."""
    scope = F.when(is_global | (kind == "no_kconfig"), F.lit("globally")).otherwise(arch)
    return F.concat_ws(".", path, block, kind, scope, suffix)
