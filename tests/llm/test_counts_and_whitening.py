"""Token counts against the libraries, whitening and its eigenvectors against exact arithmetic."""

import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matchspark.llm import eigenrefine, tokencounts, whitening
from matchspark.llm.queries import op12, op13

rng = random.Random(9)
WORDS = ["alpha", "beta", "naïve", "Ünder", "x1", "42", "日本語", "<|endoftext|>", "<s>", "don't"]
TEXTS = [None, "", " \n\t ", "a", "same text", "same text", "<|endoftext|> <s>", "▁x", " ".join(rng.choices(WORDS, k=6000)),
         "x" * 20000, "A  b\n\nc"] + [" ".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4]], "doc_id long, text string, content string, n_tokens long")


def plain_counts(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library_and_come_from_the_cache(spark, docs, tmp_path, name, monkeypatch):
    cache, path, count = str(tmp_path / "cache"), public_tokenizers.path(name), plain_counts(name)
    want = sorted((i if i % 9 else -1, len((t or "").encode()), count(t or "")) for i, t in [*enumerate(TEXTS), (4, TEXTS[4])])
    encoded = []
    honest = tokencounts.encode_misses
    monkeypatch.setattr(tokencounts, "encode_misses", lambda m, t: encoded.append(m.count()) or honest(m, t))

    def counted(some):
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["hit"])
                      for r in tokencounts.count_tokens(some, cache, tokenizer=path).collect())

    half = docs.where("doc_id < 12")
    first = counted(half)
    assert not any(r[3] for r in first) and {r[:3] for r in first} <= set(want)
    again = counted(docs)
    assert [r[:3] for r in again] == want
    seen = {t or "" for i, t in enumerate(TEXTS) if i % 9 and i < 12}
    assert encoded == [len(seen), len({t or "" for t in TEXTS} - seen)]
    assert sum(r[3] for r in again) == sum((t or "") in seen for t in [*TEXTS, TEXTS[4]])
    assert all(r[3] for r in counted(docs)) and encoded[-1] == 0
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for t in TEXTS})
    assert counted(docs.limit(0)) == []


def test_a_new_tokenizer_version_shares_no_counts(docs, tmp_path):
    changed = tmp_path / "other.json"
    changed.write_bytes(open(tokencounts.default_tokenizer(), "rb").read() + b"\n")
    cache = str(tmp_path / "cache")
    tokencounts.count_tokens(docs, cache).count()
    assert tokencounts.count_tokens(docs, cache, tokenizer=str(changed)).where("hit").count() == 0
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs, cache, tokenizer="words.txt")


def test_op12_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    count = plain_counts("byte_bpe_50k.json")
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op12(spark, str(tmp_path)).collect())
    assert got == sorted((len((t or "").encode()), count(t or ""), count(t or "") > 512) for t in [*TEXTS, TEXTS[4]])


def spectrum(values):
    """A symmetric matrix with these eigenvalues and its exact vectors, in long double."""
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(n, dtype=np.longdouble) - q.T @ q / 2)
    return (q * np.asarray(values)) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(40, 0, -1.0), np.r_[5, 5 - 1e-6, 5 - 2e-6, 4, np.linspace(3, .1, 30)], np.r_[5, 5 - 1e-9, 4, np.linspace(3, .1, 30)],
    np.r_[5, 5, 5, 4, np.linspace(3, .1, 30)], np.r_[1e6, 1, 1 - 1e-8, 1e-3, np.zeros(20)], np.ones(20), np.zeros(4), [2.0], []])
def test_eigenvectors_to_double_precision(values):
    a = spectrum(values).astype(np.float64) if len(values) else np.zeros((0, 0))
    got, x = eigenrefine.eigen(a)
    scale = max(np.abs(values), default=0)
    exact = a.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(len(a))).max(initial=0) < 1e-14
    assert np.abs(exact @ x - x * got).max(initial=0) <= 3e-16 * scale
    assert (np.diff(got) <= 0).all() and np.abs(got - np.sort(values)[::-1]).max(initial=0) <= 1e-14 * scale


def test_single_precision_alone_would_not_do():
    a = spectrum(np.r_[5, 5 - 1e-6, 4, np.linspace(3, .1, 30)]).astype(np.float64)
    single = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.float64)
    assert np.abs(a @ single - single * np.diag(single.T @ a @ single)).max() > 1e-8


def test_whitening_against_exact_arithmetic(spark, tmp_path):
    draw = np.random.default_rng(2)
    plain = (draw.normal(size=(300, 6)) * [3, 1, 1, .5, .2, .01] + 40).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(plain + plain[:40] + [[1.0, 2.0], [], [0.0] * 6])]  # copies, short ones
    rows += [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] + [1.0] * 5), (None, plain[0]), (5, plain[5])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, x string, n int")
    frame.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op13(spark, str(tmp_path)).collect()
    used = [(i, [int(np.floor(256 * float(c))) for c in v] + [0] * (6 - len(v))) for i, v in rows if i not in (900, 901, 902, 903)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert len(out) == 4 * len(used)
    want = sorted((-1 if i is None else i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in used)
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in out if r["component"] == 1) == want
    away = [[Fraction(n * c - s, n) for c, s in zip(x, sums)] for x in fit]
    v = np.array([[float(sum(a[i] * a[j] for a in away) / n) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(v)
    by_row = {}
    for r in out:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(4):
        w = {i: float(np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ u[:, -1 - k]) / e[-1 - k] ** .5 for i, x in used}
        sign = np.sign(sum(w[i] * by_row[i][k + 1]["whitened"] for i in w))
        assert all(abs(sign * w[i] - by_row[i][k + 1]["whitened"]) < 1e-8 for i in w)
        assert abs(by_row[0][k + 1]["explained"] - e[-1 - k] / e.sum()) < 1e-12 and by_row[0][1]["n"] == n
    assert 0 <= out[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in out}) == 1


def test_whitening_of_odd_tables(spark):
    kind = "vec_id string, embedding array<double>"
    made = lambda *v: whitening.whiten(spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], kind))
    assert made().count() == made([1.0, 2.0]).count() == made([1.0], [1.0], None).count() == made([], []).count() == 0
    assert [r["component"] for r in made([0.0, 5.0], [1.0, 5.0]).collect()] == [1, 1]
    huge = made([1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]).collect()
    assert {r["component"] for r in huge} == {1} and all(np.isfinite(r["whitened"]) for r in huge)
    assert sorted(r["whitened"] for r in made([0.0], [1.0]).collect()) == [-1, 1]
