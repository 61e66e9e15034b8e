"""Operators on single texts: BPE, language ID, personal data, licences."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from panelmill.llm import bpe, langid, licenses, pii
from panelmill.llm.queries import PATTERN, RANKS, token_digests
from pyspark.sql import functions as F

with open(RANKS, "rb") as _file:
    CONTENT = _file.read()
TABLE = bpe.Ranks(CONTENT)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=TABLE.ids, special_tokens={})


def _encoded(texts):
    ids, offsets = bpe.encode_texts(texts, TABLE, regex.compile(PATTERN))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_ids_are_the_librarys():
    rng = random.Random(1)
    letters = "aab'sc dré ñ\n\t  \x1c\x85 ①²½٣中文字😀ßÖ.,!?0189_-​﻿Ж"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    texts += ["", "a" * 5_000, "the " * 3_000, " " * 300, "\n" * 50, "aaab" * 40, "don't we'll I'M", "x\n \ny", "   y"]
    assert _encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_every_kind_of_character_splits_like_the_library():
    codes = [*range(0x3000), *range(0xD000, 0xD800), *range(0xE000, 0x1_1000, 7), *range(0x1F000, 0x1FB00)]
    texts = [f"a{chr(c)} 1{chr(c)}{chr(c)}\n {chr(c)}b" for c in codes]
    assert _encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_ranks_out_of_order_are_merged_one_by_one():
    """abc has a lower rank than ab, which leads to it: the block order alone would come too late."""
    content = "\n".join(f"{bpe.base64.b64encode(t).decode()} {i}" for i, t in enumerate(
        [*(bytes([b]) for b in range(256)), b"cd", b"abab", b"abc", b"ab", b"aba"])).encode()
    ranks = bpe.Ranks(content)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    ids, offsets = bpe.replay(pieces, ranks)
    for p, a, b in zip(pieces, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == ([ranks.ids[p]] if p in ranks.ids else ranks.one_by_one(p))


def test_round_trip_and_defined_cases(docs):
    frame = docs((1, "Héllo  wörld\n"), (2, None), (3, ""), (None, "x"), (1, "Héllo  wörld\n"), (4, "très long " * 20_000))
    rows = bpe.decode(bpe.encode(frame, RANKS, PATTERN), RANKS).collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == sorted((r.text or "") for r in frame.collect())
    assert all(r.ids == [] for r in rows if r.doc_id in (2, 3))
    assert token_digests(docs()).count() == 0
    assert {r.n_tokens for r in token_digests(frame).collect() if r.doc_id == 1} == {len(LIBRARY.encode_ordinary("Héllo  wörld\n"))}


# --- language ID ------------------------------------------------------------------------------

WORDS = {"en": "the and with from that which have this", "de": "und der nicht eine auch sich durch über", "fr": "les des une dans pour avec être très"}


@pytest.fixture
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(40)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(900, "the and with", None), (None, "der und nicht", "de"), (901, None, "en"), (902, "123 !!", "fr"), (903, "жук", None), (904, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(9), "word": F.lit("w")})


def test_languages_of_held_out_documents(labelled):
    model = langid.fit(labelled)
    got = {r.doc_id: r for r in langid.predict(labelled, model).collect()}
    truth = {r.doc_id: r.lang for r in labelled.filter(langid.remainder("doc_id") == 0).collect() if r.doc_id < 900}
    assert len(truth) > 10 and all(got[i].lang_pred == lang for i, lang in truth.items())
    assert (got[900].lang_pred, got[None].lang_pred) == ("en", "de")
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (901, 902, 904))
    assert (got[903].lang_pred, got[903].score) == (model.usual, 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.known_language(labelled, model)
    assert kept.columns == labelled.columns and kept.count() == 120 + 2


def test_learning_ignores_held_out_and_unlabelled_rows(labelled):
    blank = F.when(F.coalesce(langid.remainder("doc_id") == 0, F.lit(True)) | F.col("lang").isNull(), "zzz qqq").otherwise(F.col("text"))
    one, other = langid.fit(labelled), langid.fit(labelled.withColumn("text", blank))
    assert (one.slices == other.slices).all() and one.languages == other.languages


def test_masks_name_every_language_that_holds_a_gram():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03d}": np.unique(rng.integers(0, 1 << 60, 200)) for i in range(70)}  # more than one word of bits
    filters = langid.Filters.of(grams, "l000")
    for i, (lang, own) in enumerate(sorted(grams.items())):
        masks = filters.slices[i // 64][langid.positions(own)[0]]
        for at in langid.positions(own)[1:]:
            masks = masks & filters.slices[i // 64][at]
        assert (masks >> np.uint64(i % 64) & np.uint64(1)).all()  # no false negatives
        assert lang in filters.languages


def test_no_labels_or_no_rows(labelled, docs):
    unlabelled = labelled.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(labelled, langid.fit(unlabelled)).collect()} == {"und"}
    assert langid.predict(docs(), langid.fit(docs())).count() == 0


# --- personal data ----------------------------------------------------------------------------

DISGUISED = {
    "john [at] example [dot] com": ("email", "john [at] example [dot] com"),
    "a.b.c.d.e [at] host.com": ("email", "a.b.c.d.e [at] host.com"),
    "see a dot b dot c.d dot e (dot) f at host dot com": ("email", "a dot b dot c.d dot e (dot) f at host dot com"),
    "write to john.doe at example dot com now": ("email", "john.doe at example dot com"),
    "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
    "mary (at) mail.example.org": ("email", "mary (at) mail.example.org"),
    "jane arroba correo punto es": ("email", "jane arroba correo punto es"),
    "call plus one two one two five five five zero one two three": ("phone", "plus one two one two five five five zero one two three"),
    "card " + " ".join(["four"] + ["one"] * 15): ("card", " ".join(["four"] + ["one"] * 15)),
    "from one nine two dot one six eight dot zero dot one here": ("ip", "one nine two dot one six eight dot zero dot one"),
    "４５３２０１５１１２８３０３６６": ("card", "４５３２０１５１１２８３０３６６"),
}
CLEAN = ["look at the point of it", "meet at noon by the dot", "one two three four", "version 1.2.3.4.5.", "4111111111111112", "at example.com", "ein Punkt und at"]


def test_disguises_map_back_to_the_source():
    for text, (kind, source) in DISGUISED.items():
        spans = [s for s in pii.found(text) if not s[3]]
        assert [(k, text[a:b]) for k, a, b, _ in spans] == [(kind, source)], text


def test_clean_texts_get_no_added_span():
    assert [s for t in CLEAN for s in pii.found(t) if not s[3]] == []


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    pool = ["a.b@c-d.com", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0123", "+12", " ", "é", "@", ".", "9", "😀"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        want = [("email", *m.span()) for m in pii._EMAIL.finditer(text)]
        want += [("ip", *m.span()) for m in pii._IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern in (("card", pii._CARD), ("phone", pii._PHONE)):
            for m in pattern.finditer(text):
                digits = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
                luhn = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
                if 13 <= len(digits) <= 19 and luhn % 10 == 0 if kind == "card" else 9 <= len(digits) <= 15:
                    want.append((kind, *m.span()))
        assert [s[:3] for s in pii.found(text) if s[3]] == want, text


def test_spans_of_rows(docs):
    rows = {r.doc_id: r.spans for r in pii.detect(docs((1, "😀 a@b.com"), (2, None), (3, ""), (None, "x"), (4, "é " * 60_000 + "a@b.com"))).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in rows[1]] == [("email", 2, 9, True)]
    assert rows[2] == rows[3] == rows[None] == []
    assert [(s.start, s.end) for s in rows[4]] == [(120_000, 120_007)]
    assert pii.detect(docs()).count() == 0


# --- licences ---------------------------------------------------------------------------------

def test_licences_and_their_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    body = "river stone bridge mill barley lantern\n" * 30
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x", body), (3, "a/b/y", body + apache), (4, "a/b/c/d/z", body), (5, "e/w", body), (6, None, body),
        (7, "f/one", body + mit), (8, "f/two", body + apache), (9, "f/three", body), (10, "top", None), (11, "a/v", ""), (11, "a/v", ""),
        (12, "g/u", "The license of this bridge is old, and the mill is free."),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"own": F.lit(1), "dir": F.lit(2), "how": F.lit(3)})
    got = {r.doc_id: (r.licence, r.how, r.licensed_dir) for r in licenses.inherited(licenses.stated(frame, F.col("path"))).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "header", None), 4: ("Apache-2.0", "inherited", "a/b"),
        5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "header", None), 8: ("Apache-2.0", "header", None),
        9: (None, "none", None),  # its directory states two licences
        10: (None, "none", None), 11: ("MIT", "inherited", "a"), 12: (None, "none", None),
    }
    assert licenses.inherited(licenses.stated(frame.limit(0), F.col("path"))).count() == 0


def test_wrapped_headers_and_full_licence_texts(spark):
    notice = licenses.TEMPLATES["GPL-3.0"][2].split()
    header = "\n".join(" * " + " ".join(notice[i : i + 11]) for i in range(0, len(notice), 11))
    binary = licenses.TEMPLATES["BSD-3-Clause"][1].split()
    wrapped = "# " + " ".join(binary[:12]) + "\n# " + " ".join(binary[12:])
    body = "river stone bridge mill barley lantern\n" * 60
    full = {n: t.replace("<year> <copyright holders>", "2021 Some Body") for n, t in licenses.FULL.items()}
    assert len(full) == 6
    rows = [(1, "a/x", "/* mill.c\n" + header + "\n */\n" + body), (2, "b/x", body + wrapped + "\n" + body)]
    for i, (name, text) in enumerate(full.items()):
        rows += [(10 + i, f"{name}/COPYING", text), (20 + i, f"{name}/src/deep/x", body)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licenses.inherited(licenses.stated(frame, F.col("path"))).collect()}
    want = {1: ("GPL-3.0", "header"), 2: ("BSD-3-Clause", "header")}
    for i, name in enumerate(full):
        want |= {10 + i: (name, "file"), 20 + i: (name, "inherited")}
    assert got == want


def test_registered_paths_cross_levels(spark):
    from panelmill.llm.queries import invented_path

    mit, body = "Released under the MIT License.", "river stone bridge mill barley lantern\n" * 30
    frame = spark.createDataFrame([(3000, "src0", mit), (3456, "src0", body), (4456, "src0", body)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.path, r.how, r.licensed_dir) for r in licenses.inherited(licenses.stated(frame, invented_path(F.col("doc_id")))).collect()}
    assert got == {3000: ("src0/3/3000", "file", None), 3456: ("src0/3/4/3456", "inherited", "src0/3"), 4456: ("src0/4/4/4456", "none", None)}


def test_markers_lose_no_segment():
    scanner = licenses.Scanner(np.linspace(1, 6, len(licenses._TERMS)), 7.0)
    rng = random.Random(5)
    words = list(licenses._TERMS) + ["river", "stone"]
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            for _ in range(60):
                own = [rng.choice(words) if rng.random() < 0.2 else w for w in licenses.words_of(text)]
                vector, length = scanner._vector(own)
                plain = max(sum(v * u.get(w, 0) for w, v in vector.items()) / length for _, u in scanner._templates)
                assert (scanner.best(own) is not None) == (plain >= licenses.SIMILAR)
