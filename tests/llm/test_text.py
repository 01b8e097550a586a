import hashlib
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from tests.llm.conftest import prose
from variscope.llm import bpe, fingerprints, jaccard, licences, mixing, personal, token_files
from variscope.llm.queries import VOCABULARY


def test_automaton_equals_the_library(spark, odd, odd_rows):
    library = Tokenizer.from_file(VOCABULARY)
    got = bpe.decode_bpe(bpe.encode_bpe(odd.drop("ids"), VOCABULARY), VOCABULARY).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)


def test_automaton_on_a_small_merge_table():
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("aa", "ab"), ("b", "c")]
    tokens = [c + e for c in "abc" for e in ("", "</w>")] + [a + b for a, b in merges]
    automaton = bpe.TokenAutomaton({t: i for i, t in enumerate(tokens)}, merges, "</w>")

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    rng = np.random.default_rng(3)
    for _ in range(2000):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        assert [automaton.labels[i] for i in automaton.encode(word)] == plain(word), word


def test_token_files(spark, odd, odd_rows, none, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    folder = str(tmp_path / "tokens")
    files = token_files.write_token_files(odd, folder, VOCABULARY, length=64, batch=4)
    got = sorted(token_files.read_token_files(files, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i))
    packed = [(i, array("I", [*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in odd_rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(p), zlib.crc32(p.tobytes())) for i, p in packed)
    first = files.orderBy("file").first()["file"]
    reader, index = token_files.open_token_file(folder, first)
    ids, mask = token_files.sequence(reader, 1)
    assert len(ids) == 64 and mask.all() and not ids.flags.owndata
    empty = str(tmp_path / "none")
    assert token_files.read_token_files(token_files.write_token_files(none, empty, VOCABULARY), empty).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def holds(kind, span):
        digits = re.sub("[^0-9]", "", span)
        doubled = sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(reversed(digits)))
        return {"email": True, "ip": all(int(p) < 256 for p in span.split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_personal_data_equals_brute_force(spark, odd_rows, none):
    hard = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.03.4", "4111-1111-1111-1111 4111 1111 1111 1112", "++1 (555) 555-2485. +12", "x@y x@y.z. @a.b",
            "9" * 5000 + "@" + "a." * 5000 + "b", "+1" + " " * 3000, "😀 é a@b.co 😀 10.0.0.1", "12 " * 4000]
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = personal.find_personal(df).select("doc_id", personal.written(F.col("base")).alias("base"), personal.written(F.col("spans")).alias("spans")).collect()
    assert Counter((r["doc_id"], r["base"]) for r in got) == Counter((i, base_spans(t)) for i, t in rows)
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got)
    assert personal.find_personal(none.select("doc_id", "text")).count() == 0


def test_redaction(spark, odd, none):
    got = {r["doc_id"]: r for r in personal.redact(odd).collect()}
    assert got[8]["text"] == "Mail <EMAIL> or <PHONE>, card <CARD> at <IP>"
    assert got[1]["text"] is None and got[2]["text"] == "" and got[8]["row"] == "kept"
    assert personal.redact(odd).columns == odd.columns and personal.redact(odd).count() == 12
    assert personal.redact(none).count() == 0


def test_trees_add_spans_like_those_they_know(spark):
    rows = [(i, f"call phone +1 (555) {200 + i}-{1000 + i} soon") for i in range(300)] + [(1000 + i, f"sum 12{i % 90 + 10}345678901 plain") for i in range(300)]
    rows.append((5000, "call phone (555) 987-6543 soon"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.find_personal(df).select("doc_id", personal.written(F.col("spans")).alias("spans")).collect()}
    assert got[5000] == "phone:11:25"


def test_spelled_out_forms_are_added_and_redacted(spark):
    """As frequent as the plain forms; broken ones stay out."""
    rng = np.random.default_rng(6)

    def luhn(digits):
        total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits))
        return [*digits, -total % 10]

    plain, loose, broken = [], [], []
    for i in range(200):
        user, host = f"u{chr(97 + i % 26)}{i}", f"mail{i % 7}.example{i % 5}.org"
        ip = [int(x) for x in rng.integers(1, 256, 4)]
        card = "".join(map(str, luhn([4, *(int(x) for x in rng.integers(0, 10, 14))])))
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        phone = [str(rng.integers(200, 999)), str(rng.integers(200, 999)), f"{rng.integers(0, 9999):04d}"]
        dotted = ".".join(map(str, ip))
        plain += [f"write to {user}@{host} today", f"server ip {dotted} is up", f"paid with card {card} here", "call phone +1 (%s) %s-%s now" % tuple(phone)]
        at, dot = [("(at)", "."), (" (at) ", " dot "), ("[at]", "[dot]"), (" at ", " dot ")][i % 4]
        loose += [f"write to {user}{at}{host.replace('.', dot)} today", f"server ip {dotted.replace('.', ['[.]', '(.)'][i % 2])} is up",
                  f"paid with card {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} here", ["call phone %s-%s-%s now", "call phone (%s) %s-%s now", "call phone %s.%s.%s now"][i % 3] % tuple(phone)]
        broken += [f"paid with card {wrong[:4]}.{wrong[4:8]}.{wrong[8:12]}.{wrong[12:]} here", f"server ip {900 + i % 90}[.]{ip[1]}[.]{ip[2]}[.]{ip[3]} is up"]
    rows = [(i, t) for i, t in enumerate(plain + loose + broken)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in personal.find_personal(df).select("doc_id", personal.written(F.col("spans")).alias("spans")).collect()}
    first, last = len(plain), len(plain) + len(loose)
    for kind, name in enumerate(["email", "ip", "card", "phone"]):
        ids = range(first + kind, last, 4)
        assert sum(got[i].startswith(name + ":") for i in ids) >= 0.9 * len(ids), name
    added = [i for i in range(last, len(rows)) if got[i]]
    assert len(added) <= 0.02 * len(broken)
    clean = {r["doc_id"]: r["text"] for r in personal.redact(df).collect()}
    assert sum(any(f"<{k}>" in clean[i] for k in ("EMAIL", "IP", "CARD", "PHONE")) for i in range(first, last)) >= 0.9 * len(loose)


def test_trees_learn_from_all_spans(spark):
    """A kind with few base spans among very many of another is learnt, and every example has its weight."""
    rows = [(i, " ".join(f"write to u{i}x{j}@mail{j % 7}.example.org" for j in range(100))) for i in range(240)]
    rows += [(1000 + i, f"call phone +1 (555) {234 + i}-{1000 + i} now") for i in range(6)]
    rows += [(2000 + i, f"call phone (555) {634 + i}-{3000 + i} now") for i in range(6)] + [(3000, "sum 1234567890129 plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal.candidates(df).localCheckpoint()
    drawn = personal.examples(found)
    got = {(r["kind"], r["label"]): r["n"] for r in drawn.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    emails, phones = len(personal.AT_DOT), len(personal.PHONE_FORM)
    assert got == {(0, 1.0): 24_000 * emails, (0, 0.0): 24_000 * emails, (3, 1.0): 6 * phones, (3, 0.0): 6 * phones, (2, 0.0): 1}
    assert drawn.count() < 24_000
    added = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in personal.select_added(found).join(found.select("row", "doc_id").distinct(), "row").collect()}
    assert added == {(2000 + i, 3, 11, 25) for i in range(6)}


def test_licences(spark, odd, none):
    texts = {
        1: "Intro. Licensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at http.", 2: "All rights reserved.", 3: None,
        4: "Released under the MIT License. All rights reserved.\nreleased under the MIT license.", 5: "Plain text on licensing.",
        6: "This work is licensed under the GNU General Public License, version 3.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["licence_ids"], r["licences"]) for r in licences.scan_licences(df).collect()}
    assert got[1] == (["Apache2Ref", "ApacheCopy"], ["Apache-2.0"]) and got[2] == (["AllRights"], ["Proprietary"])
    assert got[3] == ([], []) and got[4][1] == ["MIT", "Proprietary"] and got[5] == ([], []) and got[6][1] == ["GPL-3.0"]
    assert licences.scan_licences(odd).count() == 12 and licences.scan_licences(none).count() == 0


NOTICES = {
    1: ("""/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */""", ["GPLTerms"], ["GPL"]),
    2: ("""# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation.""", ["LGPLRef"], ["LGPL"]),
    3: ("""// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ["MPL2Ref"], ["MPL-2.0"]),
    4: ("""Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:\r

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products.""", ["BSDSource", "BSDBinary", "BSDName"], ["BSD-3-Clause"]),
    5: ("Released into the public-domain.", ["PublicDomain"], ["Public-Domain"]),
    6: ("all-rights\nreserved", ["AllRights"], ["Proprietary"]),
    7: ("dnl licensed\ndnl under the\ndnl MIT license", ["MITRef"], ["MIT"]),
    8: ("\n".join(licences.SENTENCES[9][1].split()), ["GPLTerms"], ["GPL"]),
    9: ("all rights reserved\nreleased under the MIT license\nall rights reserved, all rights reserved", ["AllRights", "MITRef", "AllRights"], ["MIT", "Proprietary"]),
    10: ("is licensed under the\n\nMIT license", [], []), 11: ("is licensed under the. MIT license", [], []), 12: ("a licensed\n *\n * under the MIT license", [], []),
}


def test_wrapped_notices(spark):
    df = spark.createDataFrame([(i, text) for i, (text, *_) in NOTICES.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence_ids"], r["licences"]) for r in licences.scan_licences(df).collect()}
    assert got == {i: (ids, names) for i, (_, ids, names) in NOTICES.items()}
    assert all(re.search(licences.TELLING, words) for _, words in licences.SENTENCES)


def sketch_of(text, k=fingerprints.K):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())

    def chained(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h - (1 << 64) if h >> 63 else h

    sets = {chained(words[i : i + 5]) for i in range(len(words) - 4)} or ({chained([" ".join(words)])} if words else set())
    return sorted(sets)[:k]


def test_fingerprints_equal_brute_force(spark, odd_rows):
    rows = [r[:2] for r in odd_rows if r[0] is not None and r != odd_rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.with_next(df, rows=2).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        assert got[i]["text"] == (text or "") and got[i]["next_text"] == (following or "")
        assert got[i]["fingerprint"] == sketch_of(text) and got[i]["next_fingerprint"] == sketch_of(following)


def test_fingerprints_of_odd_rows(spark, odd, none):
    docs = fingerprints.with_next(odd)
    assert docs.count() == 12 and fingerprints.with_next(none).count() == 0
    one = fingerprints.with_next(odd.where("doc_id = 8")).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).first()
    assert one["next_text"] == one["text"] and len(one["edited"]) == len(one["text"])


def test_estimates_and_merging(spark):
    a, b = prose(3000, 1).split(), prose(3000, 2).split()
    texts = [(1, " ".join(a + b)), (2, " ".join(a)), (3, ""), (4, None)]
    df = fingerprints.with_fingerprint(spark.createDataFrame(texts, "doc_id long, text string"))
    f = {r["doc_id"]: r["fingerprint"] for r in df.collect()}
    pair = spark.createDataFrame([(f[1], f[2], f[3])], "a array<long>, b array<long>, e array<long>")
    r = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n"),
        fingerprints.resemblance(F.col("e"), F.col("e")).alias("ee"), fingerprints.resemblance(F.col("a"), F.col("e")).alias("ae")).first()
    assert abs(r["r"] - 0.5) < 0.15 and r["c"] > 0.75 and 4500 < r["n"] < 7500 and r["ee"] == 1 and r["ae"] == 0
    parts = spark.createDataFrame([("g", prose(500, i)) for i in range(20)] + [("e", "")], "g string, text string")
    merged = {r["g"]: r["fingerprint"] for r in fingerprints.merge_fingerprints(fingerprints.with_fingerprint(parts), ["g"]).collect()}
    every = sorted({h for i in range(20) for h in sketch_of(prose(500, i), 10**6)})[: fingerprints.K]
    assert merged == {"g": every, "e": []}


def plain_components(rows, least=85, n=4):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for group in range(25):
        base = prose(int(rng.choice([3, 9, 12, 30, 60, 200, 400])), group).split()
        for _ in range(12):
            words = list(base)
            for _ in range(int(rng.integers(0, max(1, len(words) // 15) + 1))):
                words[int(rng.integers(len(words)))] = f"w{rng.integers(1000)}"
            rows.append((int(i * 7919 % 100_003), " ".join(words)))
            i += 1
    rows += [(200_000, None), (200_001, ""), (200_002, "A b"), (200_003, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(df).collect()}
    assert got == plain_components(rows)


@pytest.mark.parametrize(("least", "n"), [(85, 4), (80, 5)])
def test_linked_sets_share_a_key(least, n):
    bands, rng = jaccard.Bands(least), np.random.default_rng(least)
    for _ in range(3000):
        a = rng.integers(0, 1 << 63, int(rng.integers(5, 300)), dtype=np.uint64)
        drop, add = int(rng.integers(0, len(a) // 8 + 1)), int(rng.integers(0, len(a) // 8 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        shared, union = len(a) - drop, len(a) + add
        if 100 * shared >= least * union and drop + add:
            assert set(bands.keys(np.unique(a)).tolist()) & set(bands.keys(np.unique(b)).tolist()), (len(a), drop, add)


def test_one_of_each_group_stays(spark, odd, none):
    kept = jaccard.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, None, 10])
    assert jaccard.without_near_copies(none).count() == 0


def test_mix(spark, odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in odd_rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    by = {r["source"]: r for r in got}
    total = sum(r["size"] for r in got)
    assert abs(sum(by[s]["target"] for s in by) - total) < 1e-6 * total and all(r["target"] <= 3 * r["source_size"] for r in got)
    for s in by:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - by[s]["target"]) <= max(r["size"] for r in got if r["source"] == s) / 2 + 1
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows.collect()) == +want


def test_mix_of_many_sources(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(str, mixing.mix(odd).collect())) == want


def test_keys_prefer_quality(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'plain words only here', '### $$$ %%% &&& ***') as text", "if(id < 3000, 'a', 'b') as source")
    got = mixing.mix(df).where("source = 'a'")
    share = got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c"))
    by = {r["odd"]: r["c"] for r in share.collect()}
    assert by[0] > by[1]


def test_digest_of_the_queries_matches(spark, odd):
    ids = bpe.encode_bpe(odd.where("doc_id = 7").select("doc_id", "text"), VOCABULARY).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).first()[0]
    want = Tokenizer.from_file(VOCABULARY).encode("one two", add_special_tokens=False).ids
    assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


@pytest.mark.parametrize("least", [80, 85])
def test_unrelated_sets_share_no_buckets(least):
    """Chance meetings don't grow with the square of the rows."""
    from collections import Counter

    rng, bands = np.random.default_rng(1), jaccard.Bands(least)
    for size in (20, 100, 400):
        met = Counter(k for _ in range(400) for k in set(bands.keys(np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))).tolist()))
        assert sum(n * (n - 1) // 2 for n in met.values()) <= 4


def test_linked_sets_share_a_bucket():
    """Sets at the threshold, also small ones with many empty words."""
    rng = np.random.default_rng(2)
    for least in (80, 85):
        bands = jaccard.Bands(least)
        for size in (8, 13, 30, 100, 333, 900):
            apart = 2 * size * (100 - least) // (100 + least)
            for _ in range(60):
                x = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))
                y = np.unique(np.concatenate([x[apart // 2 :], rng.integers(0, 2**63, size=apart - apart // 2, dtype=np.uint64)]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= least * (len(x) + len(y) - both):
                    assert set(bands.keys(x).tolist()) & set(bands.keys(y).tolist()) or np.array_equal(x, y)
