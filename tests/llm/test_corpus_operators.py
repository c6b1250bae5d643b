"""Operators over the whole corpus: packing, substring and line dedup, the Jaccard join, media matching."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerlens.llm import common, components, jaccard_join, line_dedup, media_match, packing, substring_dedup


def test_word_hashes_split_like_bytes():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab \t\n\x0b\xc2\xa0\x1c") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, b""]
    w = common.Words(texts)
    assert [w.data[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in (t or b"").split()]
    h = w.hashes()
    by: dict = {}
    for x, y in zip([x for t in texts for x in (t or b"").split()], h.tolist()):
        assert by.setdefault(x, y) == y
    assert len(set(by.values())) == len(by)


def test_word_hashes_over_blocks(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(5000))
    whole = common.Words([text]).hashes()
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert (common.Words([text]).hashes() == whole).all()


# --- packing ---------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2048), st.integers(1, 40)), max_size=12))
def test_plan_places_every_piece_once(pairs):
    h = np.zeros(2049, np.int64)
    for n, k in pairs:
        h[n] += k
    ranges = packing.plan(h)
    sequences: dict[int, list] = {}
    used = {n: [] for n in range(2049)}
    for n, a, b, first, at in ranges:
        used[n] += range(a, b)
        for r in range(a, b):
            sequences.setdefault(first + r - a, []).append((at, n))
    assert all(sorted(used[n]) == list(range(h[n])) for n in range(2049))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048
    assert len(sequences) <= max(1, -(-2 * int((h * np.arange(2049)).sum()) // 2048))


def test_linear_program_reaches_the_bound():
    weight, demand = np.array([100, 156]), np.array([30.0, 30.0])
    patterns, uses = packing.column_generation(weight, demand, 256)
    assert uses.sum() == pytest.approx(30) and (patterns.T @ uses == pytest.approx(demand))


def test_packed_documents(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.packed(documents).toPandas().sort_values(["doc_id", "start"])
    for r in documents.collect():
        ids, at = np.array([*lib.encode(r["text"], add_special_tokens=False).ids, 1], "<u4"), 0
        for p in rows[rows.doc_id == r["doc_id"]].itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    filled = 0
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        filled += g.length.sum()
    assert filled / (2048 * rows.sequence_id.nunique()) > 0.97


def test_packing_odd_rows(odd, empty):
    rows = packing.packed(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count() and packing.packed(empty).count() == 0


@pytest.mark.parametrize("text", [
    "hi <|endoftext|> you", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  \n b", "<|endoftext|", "x" + " " * 1_200_000 + "end", "\n" * 900_001, "word " + "\t" * 20_000 + " 日本",
    "w" * 100_000 + " " + "é" * 100_000,
])
def test_packing_ids_are_the_librarys(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert packing.document_ids(packing.encoder(), text).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]
    lib.encode_special_tokens = True
    assert packing.document_ids(packing.encoder(None, True), text).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]


def test_plan_of_real_lengths_is_near_the_bound(spark):
    """On the lengths of real documents the plan needs at most one sequence in a hundred more than the ids fill."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    h = np.zeros(2049, np.int64)
    for r in packing.pieces(docs, {"doc_id": F.col("doc_id")}).groupBy("length").count().collect():
        h[r["length"]] = r["count"]
    n = max(first + b - a for _, a, b, first, _ in packing.plan(h))
    assert n <= 1.01 * (h * np.arange(2049)).sum() / 2048 + 1


def test_stopped_linear_program_warns(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIVOTS", 1)
    with pytest.warns(UserWarning, match="pivots"):
        packing.column_generation(np.array([100, 156]), np.array([30.0, 30.0]), 256)


def test_sequences_carry_the_ids(documents):
    few = documents.limit(20)
    cut = common.materialize(packing.pieces(few, {"doc_id": F.col("doc_id")}, ids=True), "with_ids")
    placed = packing.pack(cut, ["doc_id", "start"])
    whole = packing.sequences(placed)
    assert sum(len(r["ids"]) for r in whole.collect()) == sum(r["length"] for r in cut.select("length").collect())


# --- substring dedup -------------------------------------------------------------------------------------------------


def test_cover_aligns_any_two_positions():
    d = substring_dedup.COVER
    for gap in range(substring_dedup.PERIOD):
        assert any((x + gap) % substring_dedup.PERIOD in d for x in d)
    assert substring_dedup.PERIOD - 1 + substring_dedup.ANCHOR == substring_dedup.WINDOW


def test_substrings_match_sql(documents, same):
    same(substring_dedup.removals(documents), substring_dedup.REMOVALS_SQL)


def windows_by_hand(rows):
    seen, out = set(), {}
    for key in sorted({(d is not None, d or 0, t or "") for d, t in rows}):
        words = key[2].encode().split()
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone |= set(range(i, i + 20))
            seen.add(w)
        out[(key[1] if key[0] else None, key[2])] = b" ".join(x for i, x in enumerate(words) if i not in gone).decode()
    return out


def test_substrings_by_hand(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(60):
        words = [f"u{rng.randint(0, 500)}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 45)
            words[10:10] = passage[a : a + rng.randint(15, 40)]
        if i % 7 == 0:
            words += ["again"] * rng.randint(18, 70)
        rows.append((i, " ".join(words)))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[3][1]), (101, None), (102, "")]
    want = windows_by_hand(rows)
    for most in (1 << 20, 200):
        monkeypatch.setattr(common.slices, "__defaults__", (most,))
        got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
        assert len(got) == len(rows)
        assert [(r["doc_id"], r["kept"], want[r["doc_id"], r["text"] or ""]) for r in got if r["kept"] != want[r["doc_id"], r["text"] or ""]] == []


def test_hot_keys_are_settled_where_they_are_met():
    """Rows of one key: few under the key, the others spread evenly, and never the earliest among them."""
    rng = np.random.default_rng(4)
    repeats, rows = common.Repeats(), []
    for _ in range(50):
        n = 400
        at = common.Places(rng.integers(0, 10**6, n), rng.integers(-(2**62), 2**62, n), rng.integers(0, 100, n))
        key = np.where(rng.random(n) < 0.5, np.uint64(7), rng.integers(1 << 40, 1 << 60, n).astype(np.uint64))
        by, flag = repeats.settle(key, at)
        rows += zip(key.tolist(), by.tolist(), flag.tolist(), zip(at.ids.tolist(), at.hashes.tolist(), at.pos.tolist()))
    hot = [r for r in rows if r[0] == 7]
    under, spread = [r for r in hot if r[2] < 2], [r for r in hot if r[2] == 2]
    assert len(under) <= 20 and min(hot, key=lambda r: r[3])[2] < 2 and all(r[1] == 7 for r in under)
    assert len({r[1] for r in spread}) > 0.9 * len(spread) and all(r[2] < 2 for r in rows if r[0] != 7)


def test_forgetting_hot_keys_keeps_results(monkeypatch):
    monkeypatch.setattr(common, "REMEMBERED", 3)
    rng = np.random.default_rng(6)
    repeats, low, rows = common.Repeats(), {}, []
    for _ in range(30):
        n = 60
        at, key = common.Places(rng.integers(0, 99, n), np.zeros(n, np.int64), rng.integers(0, 9, n)), rng.integers(0, 12, n).astype(np.uint64)
        _, flag = repeats.settle(key, at)
        for k, i, p, f in zip(key.tolist(), at.ids.tolist(), at.pos.tolist(), flag.tolist()):
            rows.append((k, (i, p), f))
            low[k] = min(low.get(k, (i, p)), (i, p))
    assert all(f < 2 for k, at, f in rows if at == low[k])


def test_many_null_ids_are_documents_of_their_own(spark):
    words = [" ".join(f"n{i}x{j}" for j in range(25)) for i in range(300)]
    rows = [(None, t) for t in words] + [(1, words[7] + " end")]
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None) and [r["kept"] for r in got if r["doc_id"] == 1] == ["end"]


def test_substrings_of_odd_rows(odd, empty):
    assert substring_dedup.removals(odd).count() == odd.count() and substring_dedup.removals(empty).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------------------


def cut_by_hand(lines):
    """The rule of the boundaries in plain integers."""
    import xxhash

    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    chunks, now, last = [], [], 0
    for i, x in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(x)
        now.append(x)
        rolled = (h * 0x9E3779B97F4A7C15 + last) & mask if i else h
        last = h
        if sum(bool(y.strip()) for y in now) >= 2 and (mixed(rolled) % 3 == 0 or len(now) >= 64):
            chunks.append(now)
            now = []
    if chunks and sum(bool(y.strip()) for y in now) < 2:
        chunks[-1] = chunks[-1] + now
    elif now:
        chunks.append(now)
    return chunks


def test_cuts_by_hand(documents):
    rng = random.Random(8)
    texts = [r["text"].encode() for r in documents.collect()]
    texts += [b"\n".join(rng.choice([b"", b" ", b"one", b"two", b"three %d" % rng.randint(0, 9)]) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for t in texts:
        lines = t.split(b"\n")
        edges = line_dedup.cut(lines)
        assert [lines[a:b] for a, b in zip(edges, edges[1:])] == cut_by_hand(lines)


def test_cuts_don_t_depend_on_what_stands_before():
    lines = [b"some line %d" % i for i in range(200)]
    a, b = line_dedup.cut(lines), line_dedup.cut([b"new first line", *lines])
    assert len({x + 1 for x in a} & set(b)) >= 0.9 * len(a)


def test_lines_of_odd_rows(odd, empty):
    rows = line_dedup.deduplicate(odd, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(rows) == odd.count() and all(r["kept"] is None for r in rows if r["text"] is None)
    assert line_dedup.removals(empty).count() == 0


def runs_by_hand(rows):
    """Of every document, the text without the lines of all runs of lines that stand earlier, without overlap, as well."""
    docs = [(d, t.split("\n")) for d, t in sorted(rows)]
    places: dict = {}
    for e, (_, lines) in enumerate(docs):
        for b, x in enumerate(lines):
            if x.strip():
                places.setdefault(x, []).append((e, b))
    out = []
    for d, (doc, lines) in enumerate(docs):
        gone = set()
        for a in range(len(lines)):
            for e, b in places.get(lines[a], ()):
                if (e, b) < (d, a):
                    k = 0
                    while a + k < len(lines) and b + k < (a if e == d else len(docs[e][1])) and lines[a + k] == docs[e][1][b + k]:
                        k += 1
                    worded = [x for x in range(a, a + k) if lines[x].strip()]
                    if len(worded) >= 2:
                        gone |= set(range(worded[0], worded[-1] + 1))
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_all_repeated_runs_of_lines_go(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [f"own line {i} {j}" for j in range(rng.randint(2, 6))]
        a, n = rng.randint(0, 20), rng.randint(2, 5)
        lines[1:1] = [rng.choice(["", " "]) if j % 5 == 4 else f"shared line {j}" for j in range(a, a + n)]
        rows.append((i, "\n".join(lines + rng.choice([[], [""], ["again"] * 5]))))
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, f"two {i}\nlines {i}") for i in range(12)] + [(300 + i, f"two {i}\nlines {i}") for i in range(12)]
    want = runs_by_hand(rows)
    assert sum(t == "" for d, t in want if d >= 300) == 12
    rng.shuffle(rows)
    for most in (1 << 20, 300):
        monkeypatch.setattr(common.slices, "__defaults__", (most,))
        got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), {"doc_id": F.col("doc_id")}).collect()
        assert sorted((r["doc_id"], r["kept"]) for r in got) == want


def test_lines_of_documents_by_hand(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = line_dedup.deduplicate(documents, {"doc_id": F.col("doc_id")}).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == runs_by_hand(rows)
    assert any(r["n_removed"] for r in got)


def test_hot_chunks_send_few_rows(spark):
    """A chunk that every text holds: all but a few of its rows travel under keys of their own, and its pairs aren't sent at all."""
    rows = [(i, f"own {i} a\nown {i} b\n" + "\n".join(f"hot {j}" for j in range(12))) for i in range(4000)]
    found = line_dedup.occurrences(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    assert found.key.value_counts().max() <= 20 and len(found) < 4000 * 11


def test_query_of_lines_removes_a_copied_passage(spark):
    rows = [(i, f"before {i}\nfirst shared line\nsecond shared line\nafter {i}") for i in range(20)]
    got = line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 2 if i else 0 for i in range(20)}


# --- Jaccard join ----------------------------------------------------------------------------------------------------


def classes_by_hand(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = min(low.get(r, 1 << 62), 1 << 62 if d is None else d)
    return sorted(str((d, len(s), None if low[root(i)] == 1 << 62 else low[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_join_matches_sql(documents, same):
    same(jaccard_join.join(documents), jaccard_join.JOIN_SQL)


@pytest.mark.parametrize("small", [False, True])
def test_join_by_hand(spark, monkeypatch, small):
    if small:  # many blocks, query chunks, slices and frequent tokens
        for name, value in (("BLOCK", 3), ("QUERIES", 2), ("FREQUENT", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(common.slices, "__defaults__", (2000,))
    rng = random.Random(11)
    rows = []
    common_part = [f"c{i}" for i in range(25)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([30, 80, 150]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(words + (common_part if g % 2 else [])).upper() if g == 0 else " ".join(words + (common_part if g % 2 else []))))
    rows += [(len(rows) + i, " ".join(common_part + [f"own{i}"])) for i in range(6)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[20][1]), (None, "one two"), (201, "one two"), (202, ""), (203, None), (204, "a b c d e"), (205, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in jaccard_join.join(df).select("doc_id", "n_shingles", "component_id").collect()) == classes_by_hand(rows)


def test_join_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = jaccard_join.join(odd)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == classes_by_hand(rows)
    assert jaccard_join.join(empty).count() == 0
    few = [(i, "a b c d e") for i in range(5)] + [(9, "x " * 200_000), (10, "x " * 200_001), (11, "y x " * 100_000 + "z")]
    got = jaccard_join.join(spark.createDataFrame(few, "doc_id long, text string"))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == classes_by_hand(few)


@pytest.mark.parametrize("tokens", [1, 200])
def test_blocks_are_bounded_by_tokens(spark, monkeypatch, tokens):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:100 + i % 20])) for i in range(30)] + [(50 + i, " ".join(base[60:] + [f"o{i}"])) for i in range(4)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == classes_by_hand(rows)


def test_work_tables_are_deleted(spark, documents):
    import pathlib

    for query in (jaccard_join.join, substring_dedup.removals, line_dedup.removals, packing.packed):
        before = set(pathlib.Path(common.shared_dir(spark).removeprefix("file:")).iterdir())
        query(documents)
        left = set(pathlib.Path(common.shared_dir(spark).removeprefix("file:")).iterdir()) - before
        assert len(left) == 1, left


def test_copies_with_shared_appendices_link(spark):
    """Copies with an appended passage that a cluster of its own has too: they start with that cluster's tokens, and the
    smaller copy has to open their block although it shares few first tokens with them."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        n = rng.choice([9, 10, 14, 19, 24])
        base = [f"b{g}w{i}" for i in range(n)]
        tail = [f"t{g}w{i}" for i in range(4 + n // 6)]
        fill = lambda k, n: [f"f{g}o{k}w{i}" for i in range(n)]
        rows.append(" ".join(base))
        rows.append(" ".join(base + tail[: (n - 4) // 4]))
        rows += [" ".join(fill(k, 9 + n // 6) + base[-4:] + tail) for k in range(6)]
        rows += [" ".join(base[: 8 + k] + fill(10 + k, 8)) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in jaccard_join.join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == classes_by_hand(list(enumerate(rows)))


def test_one_of_each_class_stays(odd, empty):
    kept = jaccard_join.representatives(odd)
    assert kept.columns == odd.columns and jaccard_join.representatives(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert rows.count((1, "a b c d e f g")) == 1 and (None, "a b c d e f g") not in rows and (2, None) in rows and (3, "") in rows


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and components.connected(links.limit(0)).count() == 0


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_ROUNDS", 1)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        components.connected(links)


# --- media -----------------------------------------------------------------------------------------------------------


def png(grey):
    h, w = grey.shape
    def chunk(k, b):
        return len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    rows = b"".join(b"\x02" + ((grey[y].astype(int) - (grey[y - 1] if y else 0)) & 255).astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x00\x00\x00\x00") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_decoders_agree():
    grey = np.random.default_rng(1).integers(0, 256, (20, 31)).astype(np.uint8)
    assert (media_match.decode(png(grey)) == grey).all() and (media_match.decode(media_match.pgm(grey)) == grey).all()
    assert media_match.decode(b"junk") is None and media_match.decode(b"\x89PNG\r\n\x1a\nxx") is None and media_match.decode(b"P5 3") is None


def png_of(width, height, depth, colour, passes, palette=b""):
    def chunk(k, b):
        return len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    lace = len(passes) > 1
    rows = b"".join(b"\x00" + row for rows in passes for row in rows)
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([depth, colour, 0, 0, lace])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_other_kinds_of_png():
    grey = np.random.default_rng(4).integers(0, 256, (13, 11)).astype(np.uint8)
    palette = bytes(v for i in range(256) for v in [255 - i] * 3)
    plain = [[row.tobytes() for row in 255 - grey]]
    assert np.abs(media_match.decode(png_of(11, 13, 8, 3, plain, palette)) - grey).max() < 0.01
    wide = [[(row.astype(">u2") * 257).tobytes() for row in grey]]
    assert np.abs(media_match.decode(png_of(11, 13, 16, 0, wide)) - grey).max() < 0.01
    bits = [[np.packbits(row > 127).tobytes() for row in grey]]
    assert (media_match.decode(png_of(11, 13, 1, 0, bits)) == np.where(grey > 127, 255, 0)).all()
    nibbles = [[bytes(a << 4 | b for a, b in zip(r[::2], [*r[1::2], 0])) for r in (grey >> 4).tolist()]]
    assert np.abs(media_match.decode(png_of(11, 13, 4, 0, nibbles)) - (grey >> 4) * 17.0).max() < 0.01
    starts = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    laced = [[row.tobytes() for row in grey[y::dy, x::dx] if len(row)] for x, y, dx, dy in starts]
    assert (media_match.decode(png_of(11, 13, 8, 0, laced)) == grey).all()
    assert media_match.decode(png_of(11, 13, 8, 3, plain)) is None


def test_bad_images_are_no_images():
    for data in (b"P5\n1 1\n0\n\x00", b"P5\n0 0\n255\n", b"P5 -1 4 255 x", b"P5\n99999999 99999999\n255\nx", b"P5\n3 3\n255\n12", b"P5", b"P5\n#"):
        assert media_match.decode(data) is None
    head = (2**31 - 1).to_bytes(4, "big") * 2 + b"\x08\x00\x00\x00\x00"
    assert media_match.decode(b"\x89PNG\r\n\x1a\n" + len(head).to_bytes(4, "big") + b"IHDR" + head + b"\0\0\0\0") is None
    bomb = png_of(4, 4, 8, 0, [[b"\0" * 50_000_000]])
    assert media_match.decode(bomb).shape == (4, 4)


def test_all_filters_of_png():
    """Rows filtered in all five ways, against the definition sample by sample."""
    rng = np.random.default_rng(9)
    grey = rng.integers(0, 256, (15, 21, 3)).astype(int)
    rows = []
    for y in range(15):
        kind = int(rng.integers(0, 5))
        row = bytearray([kind])
        for x in range(21):
            for c in range(3):
                a, b, d = (grey[y, x - 1, c] if x else 0), (grey[y - 1, x, c] if y else 0), (grey[y - 1, x - 1, c] if x and y else 0)
                p = a + b - d
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row.append((grey[y, x, c] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        rows.append(bytes(row))
    def chunk(k, b):
        return len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (21).to_bytes(4, "big") + (15).to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(b"".join(rows)))
    assert np.abs(media_match.decode(data) - grey @ np.array([0.299, 0.587, 0.114])).max() < 0.01


def pictures(rng, n, side):
    out = np.zeros((n, side, side), np.float32)
    for r in (1, 3, 7):
        x = media_match._box(media_match._box(rng.normal(0, 1, (n, side, side)).astype(np.float32), r), r)
        out += x / x.std()
    return np.clip(128 + 30 * out, 0, 255)


def by_comparing_all(rows):
    """Classes of (id, image) by comparing all pairs of images, and all pairs of copies found so."""
    sides = []
    for _, data in rows:
        _, place, bits = media_match.describe(media_match._worked(media_match.decode(data))[None])
        sides.append((place, np.ascontiguousarray(bits).view(np.uint64).reshape(-1, 2)))
    return [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if media_match.agreeing(sides[j], sides[i])]


def test_recall_against_comparing_all_pairs(spark):
    """Crops, brightness, noise, rescaling and rotation among look-alikes that share a large corner of one picture."""
    rng = np.random.default_rng(2)
    base, rows = pictures(rng, 40, 80), []
    base[20:, 40:, 40:] = base[20, 40:, 40:]  # a third of all images hold one patch
    for i, x in enumerate(base):
        edits = [x, x[9:, 6:], np.clip(x * 0.8 + 20, 0, 255), np.rot90(x), x + rng.normal(0, 6, x.shape), media_match._resized(x[None], 0.8)[0], media_match.rotated(x, 10)]
        rows += [(10 * i + k, media_match.pgm(e)) for k, e in enumerate(edits if i % 2 else edits[:3])]
    got = {r["image_id"]: r["class_id"] for r in media_match.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    true = by_comparing_all(rows)
    assert len(true) > 300
    recall = np.mean([got[a] == got[b] for a, b in true])
    print("recall against comparing all pairs", recall)
    assert recall >= 0.95
    # and nothing is joined that comparing all pairs doesn't join
    parent = {i: i for i, _ in rows}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in true:
        parent[root(a)] = root(b)
    assert all(root(i) == root(c) for i, c in got.items())


def test_a_quarter_of_a_large_picture_is_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, x in enumerate(pictures(rng, 3, 700)):
        rows += [(10 * i, media_match.pgm(x)), (10 * i + 1, media_match.pgm(x[200:550, 100:450]))]
    got = {r["image_id"]: r["class_id"] for r in media_match.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == {i: 10 * (i // 10) for i, _ in rows}


def test_one_picture_in_very_many_copies(spark, monkeypatch):
    """Buckets far larger than what one descriptor meets: all copies in one class, and copies among the others found."""
    rng = np.random.default_rng(7)
    base = pictures(rng, 6, 72)
    rows = [(i, media_match.pgm(base[0] + rng.normal(0, 3, base[0].shape))) for i in range(60)]
    for i, x in enumerate(base[1:], 10):
        x[:36] = base[0][:36]  # half of the hot picture
        rows += [(10 * i, media_match.pgm(x)), (10 * i + 1, media_match.pgm(x + rng.normal(0, 3, x.shape)))]
    got = {r["image_id"]: r["class_id"] for r in media_match.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[10 * i] == got[10 * i + 1] for i in range(10, 15))


def test_copies_that_others_hide_in_full_buckets(spark):
    """Two images whose corners each have 240 look-alikes in their bucket that lie nearer than the copy's."""
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 1 << 63, (7, 2), dtype=np.uint64)
    places = lambda: [int(x) << 34 | int(y) << 18 | 7 << 12 | int(o) for x, y, o in zip(rng.integers(8, 64, 7), rng.integers(8, 64, 7), rng.integers(0, 32, 7))]
    other = bits ^ np.array([0x3F << 40, 0xFFF << 26], np.uint64)  # 18 bits of the bands 1 to 3
    own, sides = places(), [bits, other]
    images = [(own, bits), (own, other)]
    for k in range(240):
        flips = np.uint64(1) << rng.integers(0, 64, 7).astype(np.uint64)
        images.append((places(), sides[k % 2] ^ np.stack([0 * flips, flips], 1)))
    f1 = rng.integers(-(1 << 62), 1 << 62, len(images)).tolist()
    rows = [(f1[i], i, [(p, *b) for p, b in zip(place, x.view(np.int64).tolist())]) for i, (place, x) in enumerate(images)]
    table = spark.createDataFrame(rows, "f1 long, d long, corners array<struct<place:long,b0:long,b1:long>>")
    got = {r["node"]["d"]: r["root"]["d"] for r in media_match.classes(table).collect()}
    assert got == {0: 0, 1: 0}


def test_all_pairs_of_full_buckets_are_candidates(monkeypatch):
    """The search by blocks, in pieces of any size, against a plain loop; the batched comparison against that of one pair."""
    rng = np.random.default_rng(10)
    base = pictures(rng, 24, 72)
    base[8:16, :40] = base[8, :40]
    base[16:] = base[8:16] + rng.normal(0, 8, base[:8].shape)
    sides = [media_match.describe(x[None])[1:] for x in base]
    sides = [(place, np.ascontiguousarray(b).view(np.uint64).reshape(-1, 2)) for place, b in sides]
    own = np.arange(24) // 2
    block = media_match._Side(np.arange(24), np.arange(24), own, np.array([len(p) for p, _ in sides]), *[np.concatenate(c) for c in zip(*sides)])
    want = set()
    for a in range(24):
        for b in range(a + 1, 24):
            met = {}
            for i, (p, x) in enumerate(zip(*sides[a])):
                for q, y in zip(*sides[b]):
                    bands = (x ^ y).view(np.uint32) == 0
                    if own[a] != own[b] and bands.any() and np.bitwise_count(x ^ y).sum() <= media_match.MET_BITS:
                        for cell in media_match._cells(np.array([p]), np.array([q])):
                            met.setdefault(int(cell[0]), set()).add(i % 64)
            if any(len(v) >= media_match.PROBE for v in met.values()):
                want.add((a, b))
    for most in (1 << 20, 500, 1):
        monkeypatch.setattr(media_match, "AT_ONCE", most)
        got = [(x, y) for x, y in media_match.candidates(block, block) if len(x)]
        assert {(a, b) for x, y in got for a, b in zip(x.tolist(), y.tolist())} == want
    x, y = np.triu_indices(24, 1)
    same = [media_match.agreeing(sides[a], sides[b]) for a, b in zip(x, y)]
    assert want and any(same) and media_match.agreed(block, block, x, y).tolist() == same


def test_tiles_of_images_are_dealt_over_tasks(spark):
    """The tiles of two blocks are few bytes and much work, so Spark mustn't put several of them into one task for their bytes."""
    rng = np.random.default_rng(11)
    rows = [(f1, i, [(8 << 34 | 8 << 18 | 7 << 12, i, i)]) for i, f1 in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 64).tolist())]
    images = spark.createDataFrame(rows, "f1 long, d long, corners array<struct<place:long,b0:long,b1:long>>")
    roots = spark.createDataFrame([], "node struct<d:long,f1:long>, root struct<d:long,f1:long>")
    links = media_match.rest(images, roots)
    tiles = media_match.LEAST_BLOCKS * (media_match.LEAST_BLOCKS + 1) // 2
    assert links.rdd.getNumPartitions() >= tiles and links.isEmpty()


def test_places_of_few_flags():
    rng = np.random.default_rng(12)
    for share in (0, 0.01, 0.5, 1):
        flags = rng.random(8 * 40) < share
        assert media_match._few(flags).tolist() == np.flatnonzero(flags).tolist()


def test_copies_in_the_table(spark, sf_dir):
    images = media_match.rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    got = {r["image_id"]: r["class_id"] for r in media_match.copies(images).collect()}
    assert np.mean([got[i] == got[i - 1] for i in got if i % 2]) >= 0.95


def test_media_odd_rows(spark):
    rows = [(1, None, 1), (1, b"", 2), (None, b"junk", 3), (2, b"P5\n3 3\n255\n123456789", 4), (3, b"P5\n1 1\n0\n\0", 5)]
    df = spark.createDataFrame(rows, "image_id long, image binary, f1 int")
    got = sorted(str(tuple(r)) for r in media_match.copies(df).select("image_id", "class_id").collect())
    assert got == ["(1, 1)", "(1, 1)", "(2, 2)", "(3, 3)", "(None, None)"] and media_match.copies(df.limit(0)).count() == 0
