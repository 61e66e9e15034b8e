"""Operators that relate texts: SimHash, fuzzy lines, repeated passages, benchmark items, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm import decontaminate, graph, lines, simhash, substrings
from tests.llm.conftest import PROSE


def _top(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _components(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = _top(parent, a), _top(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _top(parent, n) for n in nodes}


# --- graph ------------------------------------------------------------------------------------

def test_components_match_brute_force(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1_000, i) for i in range(1_001, 1_400)]  # a long path, a hub
    edges += [(rng.randrange(2_000, 2_300), rng.randrange(2_000, 2_300)) for _ in range(160)] + [(5, 5), (7, 8), (-3, -9)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    linked = [(a, b) for a, b in edges if a != b]
    assert got == _components({n for e in linked for n in e}, linked)


# --- SimHash ----------------------------------------------------------------------------------

def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "One two", "É Ü a\x1cb c\xa0d e", PROSE, PROSE * 300, "the " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == _plain_fingerprint(text)


def _crowd(rng, n):
    """Fingerprints with a dense ball, chains and strangers."""
    centre = rng.getrandbits(64)
    ball = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(n // 2)]
    return np.unique(np.array(ball + [rng.getrandbits(64) for _ in range(n // 2)], np.uint64))


@pytest.mark.parametrize("link", [2, 3])
def test_local_tree_finds_all_links(link):
    points = _crowd(random.Random(link), 3_000)
    a, b = simhash.links(points, link)
    pairs = [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= link)]
    at = {int(p): i for i, p in enumerate(points)}
    mine = [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    assert all(np.bitwise_count(points[i] ^ points[j]) <= 64 for i, j in mine)
    assert _components(range(len(points)), mine) == _components(range(len(points)), pairs)
    assert len(a) < 20 * len(points)  # trees of links, not pairs


def test_shards_of_the_tree_hold_every_close_pair(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 100)
    points = _crowd(random.Random(9), 2_000)
    tree = simhash.Tree.built(points[::2], len(points))
    assert len(tree.parts) > 4
    members = [set() for _ in points]
    for shard, which in tree.shards(points):
        for i in which:
            members[i].add(shard)
    for i in range(0, len(points), 7):
        assert members[i] and all(members[i] & members[j] for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= simhash.LINK))


@pytest.mark.parametrize("shard, part", [(4_000, 200_000), (20, 200_000), (4_000, 30)])
def test_near_duplicates_match_brute_force(docs, monkeypatch, shard, part):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(3)
    words = PROSE.split() * 4
    rows = [(None, ""), (90, None), (91, " "), (92, ""), (93, "One two"), (93, "One two"), (94, "one TWO")]
    for i in range(60):
        own = list(words)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    marks = [_plain_fingerprint(t or "") for _, t in rows]
    parts = _components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[parts[at]] = min(least.get(parts[at], i), i)
    frame = docs(*rows)
    got = sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in simhash.near_duplicates(frame).collect())
    assert got == sorted((repr(i), f"{marks[at]:016x}", repr(least.get(parts[at]))) for at, (i, _) in enumerate(rows))
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_duplicates_of_nothing(docs):
    assert simhash.near_duplicates(docs()).count() == 0
    assert simhash.one_of_each(docs()).count() == 0


# --- lines ------------------------------------------------------------------------------------

def _plain_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def _plain_lines(rows):
    """Removed lines by comparing all pairs."""
    seen = [(i, n, lines.normalised(line)) for i, t in rows for n, line in enumerate((t or "").split("\n")) if lines.normalised(line)]
    texts = sorted({k for _, _, k in seen})
    parts = _components(range(len(texts)), [
        (x, y) for x in range(len(texts)) for y in range(x) if _plain_similarity(texts[x], texts[y]) >= lines.SIMILAR
    ])
    part = {t: parts[i] for i, t in enumerate(texts)}
    first = {}
    for i, n, k in sorted(seen, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        first.setdefault(part[k], (i, n))
    gone = {}
    for i, n, k in seen:
        if first[part[k]] != (i, n):
            gone.setdefault(i, set()).add(n)
    return gone


@pytest.mark.parametrize("few", [6, 2])
def test_fuzzy_lines_match_brute_force(docs, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)  # 2: keys of three lines or more are searched by a tree
    rng = random.Random(4)
    base = [" ".join(rng.choice(PROSE.split()) for _ in range(30)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "\n\n---\n"), (None, base[0]), (3, "Page 1 of 9\n" * 40), (4, "page 7 OF 3!")]
    for i in range(10, 40):
        words = rng.choice(base).split()
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, "Once only " + " ".join(rng.sample(PROSE.split(), 8)) + "\n" + " ".join(words) + "\n\n" + rng.choice(base).upper()))
    got = {r.doc_id: set(r.removed) for r in lines.removed_lines(docs(*rows)).collect()}
    want = _plain_lines(rows)
    assert got == {i: want.get(i, set()) for i, _ in rows}
    assert sum(map(len, want.values())) > 60


@pytest.mark.parametrize("words", [5, 10, 25])
@pytest.mark.parametrize("typo", [False, True])
def test_short_lines_with_one_word_in_ten_changed_are_found(docs, words, typo):
    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3_000)]
    rows, similar = [], 0
    for i in range(150):
        line = rng.choices(vocabulary, k=words)
        other = list(line)
        for n in rng.sample(range(words), max(1, words // 10)):
            other[n] = line[n][:1] + "q" + line[n][2:] if typo else rng.choice(vocabulary)
        one, two = lines.normalised(" ".join(line)), lines.normalised(" ".join(other))
        rows += [(i, " ".join(line)), (1_000 + i, " ".join(other))]
        similar += one != two and lines.edit_similarity(one, two) >= lines.SIMILAR
    got = {r.doc_id: r.removed for r in lines.removed_lines(docs(*rows)).collect()}
    found = sum(got[1_000 + i] == [0] for i in range(150))
    texts = dict(rows)
    assert not any(
        got[1_000 + i] and lines.edit_similarity(*(lines.normalised(texts[k + i]) for k in (0, 1_000))) < lines.SIMILAR for i in range(150)
    )
    assert similar > 40 and found >= 0.9 * similar


@pytest.mark.parametrize("part", [4_096, 3])
def test_pairs_that_a_forest_leaves_out_are_compared(spark, monkeypatch, part):
    monkeypatch.setattr(lines, "PART", part)
    rng = random.Random(9)
    told = [rng.getrandbits(12) for _ in range(40)]  # all within reach
    rows = [(5, 100 + i, told[i]) for i in range(40)] + [(6, 100 + i, told[i]) for i in range(9)] + [(7, 100, 1), (7, 101, 2)]
    batch = pa.RecordBatch.from_pydict({n: np.array(c, np.int64) for n, c in zip(("key", "node", "told"), zip(*rows, strict=True), strict=True)})
    met = pa.Table.from_batches(list(lines._linked([batch.slice(0, 17), batch.slice(17)], 22)))
    frame = spark.createDataFrame(met.to_pylist(), "reach int, key long, a long, b long")
    forest = {(r.a, r.b) for r in frame.filter("reach = 0").collect()}
    groups = spark.createDataFrame([(100 + i, 100 + i % 2) for i in range(30)], "node long, component long")
    rest = lines._left_out(frame.filter("reach > 0"), groups).collect()
    own = {100 + i: 100 + i % 2 if i < 30 else 100 + i for i in range(40)}
    assert len(forest) < 100 and len(rest) == len(set(rest))
    assert {(r.a, r.b) for r in rest} == {(a, b) for a in own for b in own if a < b and own[a] != own[b]}


def test_line_edge_cases(docs):
    twice = docs((5, "same line here\nsame line here\n#"), (5, "same line here\nsame line here\n#"))
    assert [(r.n_lines, r.removed) for r in lines.removed_lines(twice).collect()] == [(3, [1]), (3, [1])]
    assert lines.removed_lines(docs()).count() == 0
    assert lines.removed_lines(docs((1, None))).first()[2:] == (0, [])


def test_close_marks_share_a_key():
    rng = random.Random(6)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), lines.LINK))
        assert any(k[0] == k[1] for k in lines.keys(np.array([a, b], np.uint64)))


# --- passages ---------------------------------------------------------------------------------

def _plain_passages(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, own in words:
        if i is not None:
            for s in range(len(own) - 49):
                key = tuple(own[s : s + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, own in words:
        gone = set()
        for s in range(len(own) - 49) if i is not None else ():
            if first[tuple(own[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out.append((repr(i), len(own), len(gone), " ".join(w for n, w in enumerate(own) if n not in gone)))
    return sorted(out)


def test_repeats_match_brute_force(docs):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(pool) for _ in range(n)]
    shared, other = prose(180), prose(60)
    rows = [(None, " ".join(shared)), (1, None), (2, ""), (3, "the " * 3_000), (4, "the " * 120 + "a " * 80), (5, "ab " * 200), (6, "the\x1cx " * 90)]
    for i in range(10, 70):
        a, b = sorted(rng.sample(range(len(shared)), 2))
        own = prose(rng.randint(0, 90)) + shared[a:b] + (prose(1) if i % 5 == 0 else []) + shared[b : b + rng.randint(0, 60)]
        own += other[rng.randint(0, 12) :] + prose(rng.randint(0, 40)) if i % 2 else prose(30)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(71, rows[20][1]), (71, rows[20][1]), (71, rows[30][1]), (72, " ".join(shared) * 2)]
    frame = substrings.without_repeats(docs(*rows)).collect()
    got = sorted((repr(r.doc_id), r.n_words, sum(x.end - x.start for x in r.repeats), r.kept) for r in frame)
    assert got == _plain_passages(rows)
    for r in frame:  # maximal: removed ranges neither touch nor overlap
        assert all(x.end < y.start for x, y in zip(r.repeats, r.repeats[1:]))
    assert substrings.without_repeats(docs()).count() == 0


def test_every_window_has_one_anchor():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 10, 49, 50, 51, 200)] + ["x " * 130]
    words = substrings.Words(texts)
    found = substrings.anchors(words)
    for i, t in enumerate(texts):
        own = [(f, f + r) for k, f, r in zip(found["text"], found["first"], found["runs"]) if k == i]
        covered = sorted(s for a, b in own for s in range(a, b))
        assert covered == list(range(max(len(t.split()) - 49, 0)))


# --- benchmark --------------------------------------------------------------------------------

@pytest.fixture
def benchmark(spark):
    rng = random.Random(11)
    pool = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "ne", "so", "pi") for c in ("da", "fe", "ga", "hu")]
    items = [(i, " ".join(rng.choice(pool) for _ in range(20 + i)).capitalize() + ". " + " ".join(rng.choice(pool) for _ in range(8)) + ".") for i in range(12)]
    return spark.createDataFrame([*items, (50, None), (51, "!!"), (None, "river stone lantern barley miller evening dusk " * 3)], "item_id long, text string"), items, pool


def test_benchmark_items_are_found_and_clean_documents_are_not(docs, benchmark):
    table, items, pool = benchmark
    rng = random.Random(12)
    noise = lambda n: " ".join(rng.choice(pool + PROSE.split() * 3) for _ in range(n))
    rows, want = [(900, None), (901, ""), (902, PROSE), (903, noise(4_000)), (904, noise(30))], set()
    for i, text in items:
        words = text.split()
        edited = [w if n % 9 else "changed" for n, w in enumerate(words)]  # one word in nine replaced
        rows += [(i, noise(70) + " " + text + " " + noise(50)), (100 + i, noise(33) + "\n" + " ".join(edited).upper() + " " + noise(5)), (200 + i, text)]
        rows.append((300 + i, noise(40) + " " + " ".join(words[: len(words) // 3]) + " " + noise(40)))  # a third of an item is none
        want |= {(i, i), (100 + i, i), (200 + i, i)}
    rows.append((rows[-2][0], rows[-2][1]))
    frame = docs(*rows)
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, table).collect()]
    assert set(got) == want and len(got) == len(want) + 1  # the repeated row is reported twice
    kept = decontaminate.clean(frame, table)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i >= 300)
    assert set((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, table.filter("item_id = 3 or item_id = 51")).collect()) == {x for x in want if x[1] == 3}


def test_paraphrase_needs_the_answer():
    terms = {w.encode(): n for n, w in enumerate(sorted({f"t{i}" for i in range(30)} | {"yes", "no"}))}
    item = decontaminate.Item.of(1, " ".join(f"t{i}" for i in range(30)) + ". yes no yes.", None)
    space = decontaminate.Space([item], terms, np.ones(len(terms)), np.eye(len(terms)))
    partly = " ".join(f"t{i}" if i % 3 else "x" for i in range(30))
    assert item.answer == (b"yes", b"no", b"yes")
    assert space.matches([partly + " yes no yes"])[0][0][4] and space.matches([partly + " other words here"]) == [[]]


def test_paraphrases_without_their_rarest_words_are_found(docs):
    rng = random.Random(21)
    words = [f"w{i}x" for i in range(400)]  # the first are the most frequent
    noise = lambda n: " ".join(rng.choices(words, [1 / (i + 10) for i in range(400)], k=n))
    items = [decontaminate.Item.of(i, " ".join(rng.sample(words, 30)), "seven of nine") for i in range(12)]
    rows, want = [(900 + i, noise(300)) for i in range(40)], set()
    for item in items:
        rarest = sorted(range(30), key=lambda n: -words.index(item.words[n].decode()))[:11]
        kept = [f"other{n}" if n in rarest else w.decode() for n, w in enumerate(item.words)]
        rows.append((item.item_id, noise(40) + " " + " ".join(kept) + " seven of nine " + noise(20)))
        want.add((item.item_id, item.item_id))
    frame = docs(*rows)
    space = decontaminate.fit(frame.select("doc_id", "text"), items)
    found = {(i, m[0]) for (i, _), own in zip(rows, space.matches([t for _, t in rows]), strict=True) for m in own}
    assert len(found & want) >= 0.9 * len(want)


def test_latent_space_keeps_items_apart(docs, benchmark):
    table, items, pool = benchmark
    frame = docs(*[(i, " ".join(random.Random(i).choice(pool) for _ in range(300))) for i in range(40)])
    space = decontaminate.fit(frame.select("doc_id", "text"), [decontaminate.Item.of(i, t, None) for i, t in items])
    cells = decontaminate.Cells(decontaminate.numbers_of([t for _, t in items], space.terms), len(space.terms))
    pieces = list(space.placed(cells, 5))
    where, found = (np.concatenate(c) for c in zip(*pieces, strict=True))
    cosines = found @ space.probes.T
    assert len(pieces) > 1 and (space.probe_item[cosines.argmax(axis=1)] == cells.text[where]).all() and (cosines.max(axis=1) > 0.999).all()


def test_singular_vectors_are_those_of_the_matrix():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((500, 12)) @ rng.standard_normal((12, 60))
    omega = rng.standard_normal((60, 20))
    mine = decontaminate.singular_vectors(a.T @ (a @ omega), omega)[:, :12]
    true = np.linalg.svd(a, full_matrices=False)[2][:12].T
    assert np.allclose(np.linalg.svd(true.T @ mine)[1], 1, atol=1e-6)


def test_decontamination_of_nothing(docs, benchmark):
    table, _, _ = benchmark
    assert decontaminate.contaminated(docs(), table).count() == 0
    assert decontaminate.contaminated(docs((1, PROSE)), table.limit(0)).count() == 0
    assert decontaminate.clean(docs((1, PROSE)), table.limit(0)).count() == 1


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_stages_in_order(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    before = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "exact dedup":
            assert after.select("text").distinct().count() == after.count()
        counts.append(after.count())
        before = after
    assert counts[0] == counts[1] > counts[2] >= counts[3] > counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, data)
    again = corpus_pipeline.run(spark, data)
    assert last.columns == again.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(last.collect()) == sorted(again.collect()) and last.count() == counts[4]


def test_language_stage_drops_noise_and_unlearned_languages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(200))
    keyboard = " ".join("".join(rng.choice("asdfjklqwe") for _ in range(6)) for _ in range(200))
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * 5
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 5
    turkish = "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler birbirlerine karşı " * 5
    others = [(-1 - i, t, None, "src0", None) for i, t in enumerate((noise, keyboard, polish, finnish, turkish))]
    mixed = docs.unionByName(spark.createDataFrame(others, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, mixed, data).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_takes_empty_and_null_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None)] * 3):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.count() == 0
