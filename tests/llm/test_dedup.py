"""Mixing, line and near deduplication, and fingerprints against brute force."""

import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlode.llm import common, fingerprint, linededup, minhash, mixing, neardup


def words(text):
    return [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]


# --- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left = {s: 0.0 for s in names}, 1.5 * sum(sizes.values())
    free = [s for s in names if sizes[s]]
    while left > 1e-9 and free:  # share by weight what is over, until none is above
        total, over = sum(w[s] for s in free), 0.0
        for s in free:
            out[s] += left * w[s] / total
        for s in free:
            over += max(0.0, out[s] - 2 * sizes[s])
            out[s] = min(out[s], 2.0 * sizes[s])
        left, free = over, [s for s in free if out[s] < 2 * sizes[s]]
    return out


@pytest.mark.parametrize("which", ["docs", "odd", "many"])
def test_mixing(spark, docs, odd, which):
    if which == "many":
        rng = random.Random(1)
        rows = [(i, "w " * rng.randint(1, 30), "hot" if i % 3 else f"s{i % 7}") for i in range(12000)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    else:
        df = {"docs": docs, "odd": odd}[which]
    rows = mixing.plan(df).collect()
    assert len(rows) == df.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    assert sum(sizes.values()) == sum(len(words(r["text"])) for r in df.collect())
    want = brute_targets(sizes)
    for s, total in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == total and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["taken"] <= 2 * r["size"] for r in own)
        # the mix misses its target by at most half a document (or group of repeated rows)
        largest = max(sum(x["size"] for x in own if x["doc_id"] == r["doc_id"]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= largest / 2 + 1e-6
    again = mixing.plan(df).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixed_rows(spark, odd, none):
    plan = {}
    for r in mixing.plan(odd).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    count = {}
    for r in got.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: v for k, v in plan.items() if v}
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, ("word " * 20 if i % 2 else "wo#d ### $$$ ### $$$ " * 4).strip(), "b") for i in range(2000)] + [(5000 + i, "w " * 20, "a") for i in range(4000)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("source = 'b'").collect()
    assert sum(r["copies"] - 1 for r in got if r["doc_id"] % 2) > 2 * sum(r["copies"] - 1 for r in got if r["doc_id"] % 2 == 0)


# --- lines ------------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def brute_lines(rows):
    """(place in rows, place in text) of the lines that go."""
    every = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", p, i, tuple(words(x))) for i, r in enumerate(rows) for p, x in enumerate((r["text"] or "").split("\n")))
    first, gone = {}, set()
    for z, k, t, p, i, w in every:
        if len(w) >= linededup.MIN_WORDS:
            first.setdefault(w, (z, k, t, p))
    near = {w for w in first if len(w) >= linededup.NEAR_WORDS and any(len(v) >= linededup.NEAR_WORDS and abs(len(v) - len(w)) < 2 and first[v] < first[w] and edits(v, w) == 1 for v in first)}
    for z, k, t, p, i, w in every:
        if w in first and (w in near or first[w] != (z, k, t, p)):
            gone.add((i, p))
    return gone


def random_lines(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(2, 14))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                j = rng.randrange(len(w) + 1)
                w[j : j + rng.randint(0, 1)] = rng.choice([[], ["x"], [rng.choice("ab")]])
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    df = spark.createDataFrame(random_lines(seed), "doc_id bigint, text string, line_text string")
    rows = df.collect()
    gone = brute_lines(rows)
    want = {r["doc_id"]: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (i, p) not in gone) for i, r in enumerate(rows)}
    got = linededup.deduplicated(df.select("doc_id", "text"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_line_dedup_odd_rows(spark, odd, none):
    got = linededup.deduplicated(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    text = {}
    for r in got.collect():
        text.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert text[2] == [(None, None)] and text[3] == [("", 0)] and text[6] == [("", 0)] and text[10] == [("\n\n \n", 4)]
    assert text[7] == [("a repeated row", 14)] * 2  # one document, twice
    assert linededup.deduplicated(none).count() == 0


def test_lines_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse sequence and its complement: equal under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(i, " ".join("ab"[b ^ i] for b in bits)) for i in range(2)] + [(2, "one two"), (3, "one two"), (4, "one")]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == rows[1][1]
    assert (got[2], got[3], got[4]) == ("one two", "", "one")


def test_within_one():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert linededup.within_one(a, b) == (edits(a, b) <= 1)


# --- near duplicates --------------------------------------------------------


def brute_classes(rows):
    texts = [r["text"] or "" for r in rows]
    off, sh = minhash.shingle_sets(pa.array(texts, pa.string()))
    sets, root = [set(sh[off[i] : off[i + 1]].tolist()) for i in range(len(rows))], [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        most = max(len(sets[i]), len(sets[j]))
        if texts[i] == texts[j] or (most and len(sets[i] & sets[j]) >= neardup.THRESHOLD * most - 1e-9):
            root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(r["doc_id"])
    return sorted(sorted(x, key=lambda k: (k is None, k)) for x in out.values() if x)


def brute_kept(rows):
    """Ids that stay: the least of each core that has no text in a longer one of a core with a larger largest text. All pairs are compared."""
    texts = [r["text"] or "" for r in rows]
    off, sh = minhash.shingle_sets(pa.array(texts, pa.string()))
    sets = {r["doc_id"]: set(sh[off[i] : off[i + 1]].tolist()) for i, r in enumerate(rows)}
    cores = brute_classes(rows)
    core = {d: i for i, c in enumerate(cores) for d in c}
    top = [max(len(sets[d]) for d in c) for c in cores]
    held = set()
    for a, b in itertools.permutations(sets, 2):
        if sets[a] and len(sets[a]) <= len(sets[b]) and core[a] != core[b] and top[core[a]] < top[core[b]] and len(sets[a] & sets[b]) >= neardup.THRESHOLD * len(sets[a]) - 1e-9:
            held.add(core[a])
    return sorted(min(c) for i, c in enumerate(cores) if i not in held)


def found_classes(rows):
    out = {}
    for r in rows:
        out.setdefault(r["class_id"], []).append(r["doc_id"])
    return sorted(sorted(x, key=lambda k: (k is None, k)) for x in out.values())


def near_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (1, 2, 3, 40, 4, 1, 1, 25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(size):
            w = list(base)
            for _ in range(len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w), "c"))
            i += 1
    rng.shuffle(rows)
    return rows


def test_near_dedup_fixture(spark):
    df = spark.createDataFrame(near_rows(1), "doc_id bigint, text string, class_id string")
    assert found_classes(neardup.classes(df).collect()) == brute_classes(df.collect())


def test_near_dedup_documents(spark, sf, docs):
    got = neardup.op10_minhash_near_dedup(spark, sf).collect()
    assert found_classes(got) == brute_classes(docs.collect())
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got})


def test_contained_texts_go(spark):
    """Texts cut down to a part of another, of any length: all pairs compared."""
    rng = random.Random(11)
    base = [[f"b{i}x{j}" for j in range(rng.choice([40, 90, 300, 900]))] for i in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(60):
        w = rng.choice(base)
        n = rng.randint(5, len(w))
        at = rng.randint(0, len(w) - n)
        own = [f"o{i}y{j}" for j in range(rng.choice([0, 0, n // 8, n // 4, n // 2]))]
        rows.append((100 + i, " ".join(w[at : at + n] + own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == brute_kept(df.collect())


def test_near_dedup_odd_rows(spark, odd, none):
    got = neardup.classes(odd).collect()
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert cls[2] == cls[3] == 2 and cls[5] == cls[6] == 5 and cls[7] == 7 and cls[None] is None
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda k: (k is None, k)) == [1, 2, 4, 5, 7, 8, 9, 10, None]
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_banding_reaches_its_recall():
    for p in range(8):
        bands, rows = neardup.banding(p)
        j = neardup.jaccard_floor(4**p, 4 ** (p + 1), neardup.THRESHOLD)
        assert 1 - (1 - j**rows) ** bands >= neardup.RECALL and bands * rows <= neardup.MAX_HASHES


def test_near_dedup_links_contained_texts(spark):
    rng = random.Random(7)
    long = [[f"v{rng.randrange(10**6)}" for _ in range(n)] for n in (60, 300, 900, 3000, 90, 90, 90)]
    license = [f"l{i}" for i in range(14)]
    rows = [(10 + i, " ".join(w if i < 4 else w[:40] + license + w[40:])) for i, w in enumerate(long)]
    # wholly inside, by sizes of 1.3 to 600 times; the license inside three that stay apart; 29 of 38 shingles inside
    rows += [(0, " ".join(long[0][5:50])), (1, " ".join(long[1][20:60])), (2, " ".join(long[2][:18])), (3, " ".join(long[3][7:14])), (4, " ".join(license)), (5, " ".join(long[1][100:131] + [f"n{i}" for i in range(9)]))]
    got = {r["doc_id"]: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i]["class_id"] for i in (10, 11, 12, 13)} == {10: 0, 11: 1, 12: 2, 13: 3} and got[5]["class_id"] == 1
    assert len({got[i]["class_id"] for i in (14, 15, 16)}) == 3 and got[4]["class_id"] in [got[i]["class_id"] for i in (14, 15, 16)]
    assert got[4]["n_links"] == 3 and got[11]["n_links"] == 2 and got[14]["n_links"] == 1
    assert sorted(i for i, r in got.items() if r["kept"]) == list(range(10, 17))


def test_near_dedup_three_shingles_in_four(spark):
    rows = [(2 * i + j, " ".join(f"s{i}x{k}" for k in range(5 + j))) for i in range(40) for j in range(2)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert found_classes(got) == [[2 * i, 2 * i + 1] for i in range(40)]


def test_shared_boilerplate_costs_no_pairs(spark, monkeypatch):
    """Texts with 48 of 78 shingles in each of many longer ones aren't contained: none of their pairs is listed. One with 60 of 78 is linked to all."""
    license = [f"l{i}" for i in range(70)]
    rows = [(i, " ".join([f"s{i}x{j}" for j in range(30)] + license[:50])) for i in range(30)]
    rows += [(100 + i, " ".join([f"c{i}x{j}" for j in range(200)] + license)) for i in range(30)]
    rows += [(200, " ".join([f"o{j}" for j in range(18)] + license[:62]))]
    listed, write = [], common.written

    def written(df, tag):
        out = write(df, tag)
        if tag == "by-text":
            listed.append(out.count())
        return out

    monkeypatch.setattr(common, "written", written)
    got = {r["doc_id"]: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert listed == [30] and got[200]["n_links"] == 30
    assert all(got[i]["n_links"] == 0 and got[i]["class_size"] == 1 for i in range(30)) and sum(r["kept"] for r in got.values()) == 60


def test_pairs_of_a_passage_share_its_sets(spark, monkeypatch):
    """Texts with two thirds of their words in one passage are candidates of each other, pair by pair; their sets are sent once to a group."""
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join([f"s{i}x{j}" for j in range(75 + i)] + passage)) for i in range(40)]
    rows += [(100 + i, " ".join([f"c{i}x{j}" for j in range(20)] + passage[i : i + 120])) for i in range(10)]
    seen, write = {}, common.written

    def written(df, tag):
        out = write(df, tag)
        if tag in ("cells", "sent"):
            seen[tag] = out.count()
        return out

    monkeypatch.setattr(common, "written", written)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == brute_kept(df.collect()) == [*range(40)]
    assert seen["cells"] > 400 and seen["sent"] <= 4 * len(rows)


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_shared_counts_in_blocks(spark, monkeypatch, most):
    """A key whose sets don't fit is parted in blocks: each pair is counted once, whatever their number."""
    monkeypatch.setattr(neardup, "MOST_SHINGLES", most)
    rng = random.Random(5)
    sets = {u * 2**58 - 7: sorted(rng.sample(range(300), rng.randint(5, 90))) for u in range(-30, 30)}
    pairs = [(key, a, b, len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets, key=lambda u: len(sets[u])), 2) for key in [rng.choice([3, 3, 3, 8])]]
    got = neardup.counted_in_groups(spark.createDataFrame(pairs, "key bigint, a bigint, b bigint, na int, nb int"), spark.createDataFrame([*sets.items()], "u bigint, shingles array<bigint>")).collect()
    assert sorted((r["a"], r["b"], r["hits"]) for r in got) == sorted((a, b, len({*sets[a]} & {*sets[b]})) for _, a, b, _, _ in pairs)
    none = spark.createDataFrame([], "key bigint, a bigint, b bigint, na int, nb int")
    assert neardup.counted_in_groups(none, spark.createDataFrame([], "u bigint, shingles array<bigint>")).count() == 0


def test_banding_covers_the_sizes_that_query():
    for p in range(8):
        bands, rows = neardup.banding(p)
        for larger in range(4**p, min(-(-(4 ** (p + 1)) * 4 // 3), 4**p + 200)):
            shared = -(-3 * larger // 4)
            assert 1 - (1 - (shared / (2 * larger - shared)) ** rows) ** bands >= neardup.RECALL


CLASH = ["line_text", "line_places", "mix_key", "mix_source", "mix_copies", "kept_id_", "kept_same_", "th", "z", "k", "h", "places", "cut", "c0", "c1", "core", "id", "n_same"]


def test_columns_may_have_any_names(spark, docs):
    some = docs.where("doc_id < 60").select("*", *(F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASH)))
    plain = docs.where("doc_id < 60")
    for stage in (linededup.deduplicated, neardup.keep_one, mixing.mixed):
        got, want = stage(some), stage(plain)
        assert got.columns == some.columns
        rows = got.collect()
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in want.collect())
        assert all(r[c] == f"v{i}" for r in rows for i, c in enumerate(CLASH))


# --- fingerprints -----------------------------------------------------------


def test_fingerprints(spark, docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        got = fingerprint.fingerprints(df).collect()
        assert len(got) == len(rows)
        if df is docs:
            rows.sort(key=lambda r: r["doc_id"])
            got.sort(key=lambda r: r["doc_id"])
            for i, (r, g) in enumerate(zip(rows, got)):
                a, b = r["text"], rows[(i + 1) % len(rows)]["text"]
                edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
                assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(a)
                assert g["fingerprint"] == fingerprint.as_text(fingerprint.minima(pa.array([a])))[0]
        by_text = {}
        text = {r["doc_id"]: r["text"] or "" for r in rows}
        for g in got:
            assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
            assert by_text.setdefault(text[g["doc_id"]], g["fingerprint"]) == g["fingerprint"]


def test_likeness_estimates_jaccard(docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    pairs = [(t, t[: len(t) - len(t) // 3]) for t in texts if len(t) > 1500]
    a, b = (fingerprint.minima(pa.array([p[i] for p in pairs])) for i in (0, 1))
    for (s, t), near in zip(pairs, fingerprint.likeness(a, b)):
        off, sh = minhash.shingle_sets(pa.array([s, t]))
        x, y = set(sh[: off[1]].tolist()), set(sh[off[1] :].tolist())
        assert abs(near - len(x & y) / len(x | y)) < 0.25


def test_pairs_and_small_tables(spark, none):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o q"), (3, "totally different words here"), (4, "a b c d e f g h i j k l m n o p")]
    got = fingerprint.pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [({r["a"], r["b"]}, round(r["jaccard"], 3)) for r in got] == [({1, 2}, round(13 / 15, 3))]
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "only one")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(none).count() == 0


def test_pairs_of_a_group_are_all_there(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if j == 10 * i else w for j, w in enumerate(base))) for i in range(12)]
    rows += [(100 + i, " ".join(w if j < 150 else f"y{i}{rng.randrange(9**9)}" for j, w in enumerate(base))) for i in range(12)]
    got = {frozenset((r["a"], r["b"])): r["jaccard"] for r in fingerprint.pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    off, sh = minhash.shingle_sets(pa.array([r[1] for r in rows]))
    sets = {r[0]: set(sh[off[i] : off[i + 1]].tolist()) for i, r in enumerate(rows)}
    want = {frozenset(x): len(sets[x[0]] & sets[x[1]]) / len(sets[x[0]] | sets[x[1]]) for x in itertools.combinations(sets, 2)}
    alike = {k: v for k, v in want.items() if v >= 0.75}
    assert len(alike) >= 66 and alike.keys() <= got.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_fingerprint_bands_reach_their_recall():
    for t in (0.05, 0.2, 0.5, 0.8, 0.95):
        bands, rows = fingerprint.banding(t)
        assert 1 - (1 - t**rows) ** bands >= fingerprint.RECALL and bands * rows <= fingerprint.MAX_HASHES
