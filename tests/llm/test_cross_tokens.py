"""Alignment of two tokenizers against a plain token-by-token version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from matchspark.llm import crosstokens
from matchspark.llm.queries import op11

rng = random.Random(5)
WORDS = ["alpha", "naïveté", "Ünder", "x1", "42", "日本語", "<|endoftext|>", "<s>", "don't", "tokenization", "😀", "a\tb", "\n", "  ", "…"]
TEXTS = [None, "", " ", "a", "same text", "same text", "<|endoftext|> <s>", "▁x y", "x▁ y", " lead and trail ", "A  b\n\nc   d", "\0 x", "x" * 3000,
         " ".join(rng.choices(WORDS, k=4000)), "é ẛ̣", "tab\t\ttab \x85 nel", "　wide 　space"]
TEXTS += [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(40)]


def plain_tokens(path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def of_a(text):
        return [(t, bytes(letter[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(t, bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode())
                for t in b.encode(text) for p in [b.id_to_piece(t)]]

    return of_a, of_b


def plain_links(a, b):
    """((group text), links) by comparing byte ranges of all tokens."""
    def spans(tokens):
        at, out = 0, []
        for t, raw in tokens:
            out.append((t, at, at + len(raw)))
            at += len(raw)
        return out

    a, b = spans(a), spans(b)
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(t) for t, s, e in side if start <= s and e <= end) for side in (a, b)))
        start = end
    links, j = [], 0
    for t, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((t, b[k][0]))
            k += 1
    return groups, links


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, i, "clash", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4]], "doc_id long, text string, n_a int, chunk string, pairs string")


def expected():
    of_a, of_b = plain_tokens(*crosstokens.default_tokenizers())
    found, total = [], Counter()
    for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]:
        a, b = (of_a(t), of_b(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        groups, links = plain_links(a, b) if a else ([], [])
        total.update(links)
        found.append((i if i % 9 else -1, len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted((i, a, b, len(g), len(k), sum(total[p] == most[p[1]] for p in k), sum(total[p] for p in k),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, k in found)


def listed(out):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]) for r in out.collect())


def test_alignment_equals_the_plain_version(spark, docs, tmp_path, monkeypatch):
    want = expected()
    assert sum(r[1] == 0 for r in want) >= 4 and any(r[3] < r[4] for r in want)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert listed(op11(spark, str(tmp_path))) == want
    assert crosstokens.align(docs.limit(0)).count() == 0


def test_small_chunks_give_the_same(docs):
    tok = crosstokens.tokenizers_of(*crosstokens.default_tokenizers())
    texts = [t for t in TEXTS] * 2
    whole = crosstokens._chunk(texts, *tok)
    apart = [crosstokens._chunk([t], *tok) for t in texts]
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        assert whole[c].tolist() == [int(x[c][0]) for x in apart]
    assert whole["groups_sha256"] == [x["groups_sha256"][0] for x in apart]
    pairs = Counter()
    for x in apart:
        pairs.update({(p["a"], p["b"]): p["links"] for p in x["pairs"].to_pylist()})
    assert {(p["a"], p["b"]): p["links"] for p in whole["pairs"].to_pylist()} == dict(pairs)


def test_distinct_windows_are_aligned_once(monkeypatch):
    tok, aligned = crosstokens.tokenizers_of(*crosstokens.default_tokenizers()), []
    honest = crosstokens.Alignment
    monkeypatch.setattr(crosstokens, "Alignment", lambda a, *more: aligned.append(len(a)) or honest(a, *more))
    once = crosstokens._chunk(["alpha beta gamma"], *tok)
    often = crosstokens._chunk(["alpha beta gamma " * 500], *tok)
    assert len(often["windows"]) > 400 * len(once["windows"]) / 2 and aligned[1] <= aligned[0] + 3
    assert np.max(often["windows"]) + 1 == len(often["link_ends"])


def test_rows_of_chunks_are_smaller_than_their_numbers(docs):
    """the arrays of a chunk's windows and links weighed more than its text in every stage."""
    paths = crosstokens.default_tokenizers()
    text = " ".join(random.Random(1).choices(WORDS, k=30_000))
    made = crosstokens._chunk([text, "", text[:500]], *crosstokens.tokenizers_of(*paths))
    row = crosstokens.chunks(docs.sparkSession.createDataFrame([(1, text), (2, ""), (3, text[:500])], "doc_id long, text string").coalesce(1), paths).first()
    got = crosstokens._unpacked(bytes(row["packed"]))
    assert all(np.array_equal(got[c], made[c]) for c in crosstokens._INTS)
    assert 2 * len(row["packed"]) < 4 * sum(len(made[c]) for c in crosstokens._INTS)
    assert not any(len(v) > len(row["packed"]) // 16 for c, v in row.asDict().items() if isinstance(v, list) and c != "pairs")
