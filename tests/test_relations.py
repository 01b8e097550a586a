"""Formulas from configuration dumps: comparisons, and what has no translation."""

from variscope.operators import relations as T

SAME = "((CONFIG_A && CONFIG_B) || (CONFIG_A_MODULE && CONFIG_B_MODULE) || ((!CONFIG_A && !CONFIG_B) && (!CONFIG_A_MODULE && !CONFIG_B_MODULE)))"
TEXTS = {
    "A=B": SAME, "A=B && C": f"({SAME} && CONFIG_C)", "C || A=B": f"(CONFIG_C || {SAME})", "y=A": "CONFIG_A", "A!=n && C": "((CONFIG_A_MODULE || CONFIG_A) && CONFIG_C)",
    "A=8 && C": None, "C || A=8": None, "A=8": None, "(A=8 || B) && C": None, "!(A && B)": None, "y=m && C": None, "CHOICE_1": "", "CHOICE_1 && C": "CONFIG_C",
    "A!=B": "((CONFIG_A && !CONFIG_B) || (CONFIG_A_MODULE && !CONFIG_B_MODULE) || (!CONFIG_A && CONFIG_B) || (!CONFIG_A_MODULE && CONFIG_B_MODULE))",
}


def dump(spark, rows):
    items = [("m", "Item", n, ["boolean"]) for n in "ABCDEFGH"] + [("m", "HasPrompts", n, ["0" if n in "EFGH" else "1"]) for n in "ABCDEFGH"]
    rel = spark.createDataFrame(items + [("m", *r) for r in rows], "arch string, relation string, item string, args array<string>")
    return rel, T.option_symbols(rel)


def test_terms_without_translation_make_the_text_null(spark):
    _, symbols = dump(spark, [])
    exprs = spark.createDataFrame([("m", e, e, False) for e in TEXTS], "arch string, id string, expr string, module boolean")
    assert {r["id"]: r["text"] for r in T.literal_values(exprs, symbols).collect()} == TEXTS


def test_rules_without_translation_are_listed(spark):
    rel, symbols = dump(spark, [
        ("Depends", "A", ["B=8 && C"]), ("Depends", "D", ["B"]), ("Default", "E", ["y", "B=8"]), ("Default", "E", ["y", "A"]), ("Default", "F", ["y", "A"]),
        ("ItemSelects", "B", ["G", "C=8"]), ("ItemSelects", "C", ["H", "CHOICE_1"]),
    ])
    listed = T.unsupported_rules(rel, symbols)
    assert {tuple(r) for r in listed.collect()} == {("m", "CONFIG_A", "dependency", "B=8 && C"), ("m", "CONFIG_E", "default", "B=8"), ("m", "CONFIG_B", "select", "C=8")}
    assert {tuple(r) for r in T.unsupported_counts(listed).collect()} == {("m", "dependency", 1), ("m", "default", 1), ("m", "select", 1)}
    got = {r["symbol"]: r["formula"] for r in T.assemble_model(rel).collect()}
    assert got == {
        "CONFIG_A": "", "CONFIG_B": "", "CONFIG_C": "CONFIG_H", "CONFIG_D": "CONFIG_B", "CONFIG_E": "", "CONFIG_F": "(CONFIG_A)", "CONFIG_G": "(CONFIG_B)", "CONFIG_H": "(CONFIG_C)",
    }
