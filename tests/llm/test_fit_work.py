"""The work of fits and searches is bounded by what the texts share with the queries, with the results of the plain way."""

import random

import numpy as np
import pytest

from panelmill.llm import decontaminate


def _plain_sketch(texts, weight, omega):
    """A'(A omega) from passages made word by word, and how many passages there are."""
    half, rows = decontaminate.Cells.HALF, []
    for text in texts:
        cells = [text[i : i + half] for i in range(0, len(text), half)]
        for one, two in zip(cells, cells[1:]) if len(cells) > 1 else [(cell, []) for cell in cells]:
            row = np.zeros(len(weight))
            for cell in (one, two):
                for term in {t for t in cell if t >= 0}:
                    row[term] += weight[term]
            rows.append(row / (np.linalg.norm(row) or 1))
    a = np.array(rows)
    return a.T @ (a @ omega), len(rows)


@pytest.mark.parametrize("dense, pairs", [(4_096, 1 << 21), (7, 1 << 21), (7, 64), (0, 64), (0, 1 << 21)])
def test_products_of_terms_give_the_sketch(monkeypatch, dense, pairs):
    monkeypatch.setattr(decontaminate, "DENSE", dense)
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    texts = [(rng.zipf(1.4, n) % 24 - 2).clip(-1).astype(np.int32) for n in (1, 5, 16, 17, 400, 0, 33, 90)] + [np.full(40, -1, np.int32)]
    weight, omega = rng.random(30) + 0.5, rng.standard_normal((30, 6)).astype(np.float32)
    want, passages = _plain_sketch(texts, weight, omega)
    products = decontaminate.Products(weight, rng.integers(0, 9, 30), omega)
    for some in (texts[:3], [], texts[3:]):
        products.add(decontaminate.Cells(some, len(weight)))
    assert products.passages == passages and np.allclose(products.sketch(), want)


def _space(items):
    terms = {w: n for n, w in enumerate(sorted({w for i in items for w in i.words}))}
    return decontaminate.Space(items, terms, np.ones(len(terms)), np.eye(len(terms)))


def test_texts_without_enough_words_of_an_item_are_not_cut_into_words_again(monkeypatch):
    words = [f"w{i}x" for i in range(30)]
    space = _space([decontaminate.Item.of(1, " ".join(words), "none")])
    near = [" ".join(words[:14] + ["other"] * n + words[:8]) for n in range(20)]  # near by their words, but under half of them are there
    seen, cut = [], decontaminate.words_of
    monkeypatch.setattr(decontaminate, "words_of", lambda text: seen.append(text) or cut(text))
    assert [len(own) for own in space.matches([*near, " ".join(words)])] == [0] * 20 + [1]
    assert len(seen) <= 21 + 2  # every text once, the one that holds the item and its neighbour again; all of them again before


@pytest.mark.parametrize("far, bits", [(16, 1 << 24), (1, 1 << 24), (16, 1), (0, 1)])
def test_no_match_is_lost_by_looking_words_up_first(monkeypatch, far, bits):
    rng = random.Random(31)
    pool = [f"w{i}x" for i in range(150)]
    items = [decontaminate.Item.of(i, " ".join(rng.choices(pool, k=n)), None) for i, n in enumerate((3, 9, 16, 17, 30, 48, 49, 70, 130, 300))]
    noise = lambda n: rng.choices([*pool[:10], "other", "words"], k=n)
    texts = [""]
    for item in items:
        own = [w.decode() if rng.random() > 0.15 else "changed" for w in item.words]
        texts += [" ".join(noise(before) + own + noise(after)) for before, after in ((0, 0), (5, 0), (31, 200), (700, 3))]
    plain = _space(items)
    plain._around = lambda c, cell, item: np.ones(len(cell), bool)  # every near item is compared
    want = plain.matches(texts)
    monkeypatch.setattr(decontaminate, "FAR", far)
    monkeypatch.setattr(decontaminate, "BITS", bits)
    assert sum(map(len, want)) > 20 and _space(items).matches(texts) == want
