"""Near copies, bucket links and what must not be lost, against brute force."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from matchspark.llm import editwalk, fingerprint, forest, nearcopies
from matchspark.llm.queries import op4, op6

rng = random.Random(8)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def joined(items, near):
    """Smallest key of the component of every key, all pairs compared."""
    root = {k: k for k in items}
    for a in items:
        for b in items:
            if a < b and root[a] != root[b] and near(items[a], items[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited(words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_duplicates_stage_equals_brute_force(spark):
    rows, passage = [], [f"p{i}" for i in range(60)]
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([40, 200, 900]))]
        rows.append(words)
        rows += [edited(words, share) for share in (0.004, 0.01, 0.02, 0.03, 0.05)]
        chain = words
        for _ in range(5):  # near texts in a row, the last far from the first
            chain = chain[:]
            at = rng.randrange(len(chain))
            chain[at:at + len(chain) // 15 + 1] = [f"c{rng.randrange(10**6)}"]
            rows.append(chain)
    rows += [passage + [f"x{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]  # a common passage is no near copy
    rows += [["Same", "short"], ["same", "SHORT"], [], [" "]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, " ".join(w), "k") for i, w in enumerate(rows)], "doc_id long, text string, source string")
    sets = {i: five_words(" ".join(w)) for i, w in enumerate(rows)}
    want = joined(sets, lambda x, y: similar(x, y) if x and y else x == y)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.classes(docs).collect()}
    assert got == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert nearcopies.classes(docs.limit(0)).count() == 0


def test_texts_around_a_common_passage_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Eighty texts share buckets and no bound tells them apart: only near ones may reach the exact comparison."""
    base, rows = [f"b{i}" for i in range(1500)], []
    for i in range(80):
        at = rng.randrange(1250)
        rows.append(base[:at] + [f"u{i}x{k}" for k in range(200)] + base[at + 200:])
    for i in range(0, 80, 8):  # near copies of some of them
        rows.append(rows[i][:-90] + [f"v{i}x{k}" for k in range(90)])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = {i: five_words(" ".join(w)) for i, w in enumerate(rows)}
    want = joined(sets, similar)
    assert 60 < len(set(want.values())) < 85
    links, compared = nearcopies.buckets.near_links, []

    def watched(members, facts, verify, *more):
        def counted(pairs):
            compared.append(pairs.count())
            return verify(pairs)
        return links(members, facts, counted, *more)

    monkeypatch.setattr(nearcopies.buckets, "near_links", watched)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.classes(docs).collect()} == want
    assert max(compared) <= 3 * len(rows)


def test_balls_of_simhash_codes_meet_whatever_is_two_bits_apart(spark):
    """The near-duplicate stage takes candidates from SimHash codes and their one-bit balls, none lost in a block."""
    def apart(x, y):
        return sum(1 for p, q in zip(x, y) if bin(p ^ q).count("1") <= 2)

    base = [rng.randrange(2**nearcopies.CODE_BITS) for _ in range(120)]
    codes = [[c, rng.randrange(2**nearcopies.CODE_BITS)] for c in base]
    for flips in (0, 1, 2, 3):
        for c in base[:60]:
            for k in rng.sample(range(nearcopies.CODE_BITS), flips):
                c ^= 1 << k
            codes.append([rng.randrange(2**nearcopies.CODE_BITS), c] if flips % 2 else [c, c])
    codes += [codes[0]] * 50  # many nodes of one code
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if apart(codes[i], codes[j])}
    met = nearcopies.balls(spark.createDataFrame(list(enumerate(codes)), "node long, codes array<long>")).collect()
    buckets = {}
    for r in met:
        buckets.setdefault(r["bucket"], set()).add(r["node"])
    assert len(want) > 1000 and {(i, j) for b in buckets.values() for i in b for j in b if i < j} == want
    assert min(map(len, buckets.values())) > 1

    found = 0
    for _ in range(50):  # similarity 0.9: a code of 64 bits would differ in seven places
        words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        x = nearcopies.shingle_set(" ".join(words))
        y = nearcopies.shingle_set(" ".join(words[:-26] + [f"n{i}" for i in range(26)]))
        found += apart(nearcopies.ball_codes(x).tolist(), nearcopies.ball_codes(y).tolist()) > 0
    assert found >= 48


def test_fingerprint_classes_of_chains_equal_brute_force(spark, tmp_path):
    letters = "abcdefghijklmnop qrstuvwxyz"
    texts = []
    for n in (300, 700, 1500, 3000):
        text = "".join(rng.choice(letters) for _ in range(n))
        for _ in range(10):  # each near the one before, the last far from the first
            texts.append(text)
            at = rng.randrange(n // 2, n)
            text = text[:at] + "".join(rng.choice(letters) for _ in range(n // 40)) + text[at + n // 50:]
    texts += [texts[0], "", "a", "ab", None]
    prints = [p.hex() for p in editwalk.embed([editwalk.classes(t or "") for t in texts])]
    want = joined(dict(enumerate(prints)), lambda x, y: editwalk.likeness(bytes.fromhex(x), bytes.fromhex(y)) >= 0.8)
    near = {frozenset((a, b)) for a in prints for b in prints
            if a != b and editwalk.likeness(bytes.fromhex(a), bytes.fromhex(b)) >= 0.8}
    assert any(want[i] == want[j] and i < j and editwalk.likeness(*map(bytes.fromhex, (prints[i], prints[j]))) < 0.8
               for i in want for j in want)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in op4(spark, str(tmp_path)).collect()}
    assert {i: r["class_id"] for i, r in out.items()} == want
    for i, r in out.items():
        degree = sum(prints[i] in pair for pair in near)
        assert (degree > 0) == (r["n_links"] > 0) and r["n_links"] <= degree
    assert fingerprint.with_classes(frame.limit(0)).count() == 0


def test_the_forest_of_the_secret_scan_stands_in_no_filter(spark, tmp_path):
    spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, None), (3, "clean")],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op6(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("RLIKE" in line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Filter"))
    assert [r["doc_id"] for r in out.collect()] == [1]


def walked_prints(n_components, each):
    """Fingerprints in families: each near the one before, families far from each other."""
    out = []
    for _ in range(n_components):
        raw = bytearray([9]) + bytearray(rng.randrange(1, 256) for _ in range(3 * editwalk.SAMPLES))
        for _ in range(each):
            out.append(bytes(raw))
            for at in rng.sample(range(1, len(raw)), 20):
                raw[at] = rng.randrange(1, 256)
    return out


def test_one_bucket_of_2000_members_in_500_components(spark):
    prints = walked_prints(500, 4)
    rng.shuffle(prints)
    near = lambda x, y: editwalk.likeness(x, y) >= 0.8
    want = {}
    for i, p in enumerate(prints):  # components by growing lists, all pairs compared
        met = [r for r, group in want.items() if any(near(p, q) for _, q in group)]
        first = min([i, *met])
        want[first] = [(i, p)] + [x for r in met for x in want.pop(r)]
    assert 400 < len(want) < 700
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, print binary")
    members = frame.select(F.lit(7).cast("long").alias("bucket"), "node")
    for block in (100, 8192):  # across twenty blocks, and in one
        links, roots = forest.near_links(members.unionByName(members.limit(9)), frame, 0.8, block)
        root = {r["node"]: r["root"] for r in roots.collect()}
        groups = {}
        for i in range(len(prints)):
            groups.setdefault(root.get(i, i), set()).add(i)
        assert {frozenset(g) for g in groups.values()} == {frozenset(i for i, _ in g) for g in want.values()}
        pairs = [(r["a"], r["b"]) for r in links.collect()]
        assert len(set(pairs)) == len(pairs) < 2 * len(prints)
        assert all(a < b and near(prints[a], prints[b]) for a, b in pairs)
    links, roots = forest.near_links(members.limit(0), frame, 0.8)
    assert links.count() == 0 and roots.count() == 0
