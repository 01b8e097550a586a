"""Readers of text formats on small files, and writers read back."""

from collections import Counter

from pyspark.sql import functions as F

from variscope.operators import sinks as K
from variscope.sources import text as S


def put(folder, **files):
    for name, body in files.items():
        path = folder / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(folder)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_source_lines(spark, tmp_path):
    path = put(tmp_path, **{"arch__x86__a_DOT_c": "#ifdef A\ncode\n#endif\n", "b_DOT_h": "one\n\nthree", "c_DOT_txt": "no source\n"})
    files, lines = S.read_source_lines(spark, path)
    names = {r["file_id"]: r for r in files.collect()}
    assert sorted((r["path"].split("/")[-1], r["arch"]) for r in names.values()) == [("a.c", "x86"), ("b.h", None)]
    got = sorted((names[r["file_id"]]["path"].split("/")[-1], r["line_no"], r["txt"]) for r in lines.collect())
    assert got == [("a.c", 1, "#ifdef A"), ("a.c", 2, "code"), ("a.c", 3, "#endif"), ("b.h", 1, "one"), ("b.h", 2, ""), ("b.h", 3, "three")]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    put(tmp_path, **{"big_DOT_c": "".join(f"line {i}\n" for i in range(1, 3001))})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        _, lines = S.read_source_lines(spark, str(tmp_path))
        assert lines.filter(F.col("txt") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_models(spark, tmp_path):
    values = " ".join(f'"CONFIG_W{i}"' for i in range(40))
    path = put(tmp_path, x86_DOT_model=f'I: Items-Count: 2\nMETA SCHEMA_VERSION 1.1\nMETA ALWAYS_ON {values}\nCONFIG_A "CONFIG_B && !CONFIG_C"\nCONFIG_B\nCONFIG_A "late"\n')
    assert rows(S.read_model(spark, path, "META"), "arch", "symbol", "formula") == [("x86", "CONFIG_A", "CONFIG_B && !CONFIG_C"), ("x86", "CONFIG_B", "")]
    meta = rows(S.read_model_meta(spark, path, "META"), "arch", "key", "value")
    assert len(meta) == 41 and ("x86", "ALWAYS_ON", "CONFIG_W39") in meta


def test_model_text_read_back(spark, tmp_path):
    model = spark.createDataFrame([("x86", "CONFIG_A", "CONFIG_B"), ("x86", "CONFIG_B", "")], "arch string, symbol string, formula string")
    on = spark.createDataFrame([("x86", "CONFIG_B"), ("x86", "CONFIG_D")], "arch string, symbol string")
    lines = K.model_text(model, on, "META").orderBy("section", "symbol").collect()
    path = put(tmp_path, x86_DOT_model="\n".join(r["line"] for r in lines) + "\n")
    assert rows(S.read_model(spark, path, "META"), "symbol", "formula") == [("CONFIG_A", "CONFIG_B"), ("CONFIG_B", "")]
    assert ("ALWAYS_ON", "CONFIG_D") in rows(S.read_model_meta(spark, path, "META"), "key", "value")


def test_clauses(spark, tmp_path):
    path = put(tmp_path, arm_DOT_cnf="c File Format: x\nc sym A 1\nc var CONFIG_A 1\nc var CONFIG_B 2\nc meta_value ALWAYS_ON CONFIG_A CONFIG_B\np cnf 2 2\n1 -2 0\n-1\n2 0\n")
    got = S.read_clauses(spark, path)
    assert rows(got["var"], "model", "name", "id") == [("arm", "CONFIG_A", 1), ("arm", "CONFIG_B", 2)]
    assert rows(got["sym"], "name", "type_code") == [("A", 1)] and rows(got["meta"], "key", "value") == [("ALWAYS_ON", "CONFIG_A"), ("ALWAYS_ON", "CONFIG_B")]
    assert rows(got["literal"], "clause_id", "var", "positive") == sorted([(0, 1, True), (0, 2, False), (1, 1, False), (1, 2, True)], key=str)


def test_model_dir_prefers_formulas(spark, tmp_path):
    path = put(tmp_path, arm_DOT_cnf="c var X 1\n1 0\n", mips_DOT_cnf="c var Y 1\n1 0\n", arm_DOT_model="CONFIG_A\n")
    got = S.read_model_dir(spark, path, "META")
    assert rows(got["model"], "arch") == [("arm",)] and rows(got["var"], "model", "name") == [("mips", "Y")]


def test_relations_and_types(spark, tmp_path):
    many = " ".join(f'"a{i}"' for i in range(30))
    path = put(tmp_path, x86_DOT_rsf=f'Item\tA\tboolean\nDepends\tA\t"B && C"\nUnknown\tA\tx\nDefault\tB\t{many}\n')
    got = {(r["relation"], r["item"]): r["args"] for r in S.read_relations(spark, path).collect()}
    assert got[("Depends", "A")] == ["B && C"] and len(got[("Default", "B")]) == 30 and len(got) == 3
    assert rows(S.read_symbol_types(spark, path), "arch", "symbol", "type") == [("x86", "A", "boolean")]


def test_configs_and_lists(spark, tmp_path):
    path = put(tmp_path, c1_DOT_config='CONFIG_A=y\n# CONFIG_B is not set\nCONFIG_S="a b"\n# note\n')
    assert rows(S.read_configs(spark, path), "symbol", "value") == [("CONFIG_A", "y"), ("CONFIG_B", "n"), ("CONFIG_S", '"a b"')]
    path = put(tmp_path / "l", list="CONFIG_A # why\n\n#all\nCONFIG_B\nCONFIG_A\n")
    assert rows(S.read_list(spark, path), "item") == [("CONFIG_A",), ("CONFIG_B",)]


def test_traces_modules_messages_flags(spark, tmp_path):
    trace = "# tracer: function\n  bash-1 [000] 1.0: vfs_read+0x10/0x40 <ffffffff81000010> <-sys_read+0x4/0x9 <ffffffff81000204>\nnoise\n"
    got = S.read_trace(spark, put(tmp_path / "t", trace=trace)).collect()
    assert [(r["func"], int(r["addr"]), int(r["caller_addr"])) for r in got] == [("vfs_read", 0xFFFFFFFF81000000, 0xFFFFFFFF81000204)]
    modules = "ext4 1000 1 - Live 0xffffffffa0000000\nbad line\n"
    assert [(r["name"], int(r["base"]), r["size"]) for r in S.read_modules(spark, put(tmp_path / "m", modules=modules)).collect()] == [("ext4", 0xFFFFFFFFA0000000, 1000)]
    got = S.read_tool_messages(spark, put(tmp_path / "o", c7_DOT_log="a.c:1: warning: x\nmore\n"))
    assert rows(got, "config_id", "seq", "line") == [("c7", 1, "a.c:1: warning: x"), ("c7", 2, "more")]
    flags = S.read_define_flags(spark, put(tmp_path / "f", flags="-DA=1 -Wall -DB -DC=x=y\n"))
    assert Counter(r["line"] for r in flags.collect()) == Counter(["#define A 1", "#define B 1", "#define C x=y"])
