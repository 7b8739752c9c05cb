"""Every operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, and
extra columns with clashing names."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tramline.llm")

from tramline.llm import exact_dedup, neighbours, quality, simhash, similar, substring, token_counts, token_files, toxicity  # noqa: E402
from tramline.llm.packing import RoomTree, first_fit, pack, pack_documents  # noqa: E402
from tramline.llm.pieces import PieceCodec, decode, decode_pieces, encode_pieces, piece_texts  # noqa: E402
from tramline.llm.tokens import WordEncoder, tokenizer_path  # noqa: E402

BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, n_tokens string, fp string, ids string, digest string, keep string, group string, spans string"
CLASH = ("x",) * 8


def odd_texts(n: int, seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    parts = ["a", "The", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'ll", "!", "22", "<|endoftext|>", "<|", "中", "ß", "🎉", "▁", "\ue000", "don't ", "word, ", "x" * 50]
    return [None, "", " ", "\n", *("".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n))]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, a hot passage, nulls, ties and one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one two"), (None, "null id"), (None, "null id"), (6, " ".join(make(4000))), (7, "w " * 300)]
    passage = make(60)
    for k in range(10, 60):
        words = make(r.randint(20, 120))
        if k % 3 == 0:
            words[10:10] = passage[: r.randint(30, 60)]
        rows.append((k, " ".join(words)))
        if k % 7 == 0:
            rows.append((k + 100, " ".join(words)))
        if k % 5 == 0:
            changed = list(words)
            changed[len(changed) // 2] = "changed"
            rows.append((k + 200, " ".join(changed)))
    rows += [(12, rows[12][1]), (300, rows[20][1].upper())]
    return rows


def test_tokens_as_the_library_gives_them():
    for path, spaces in ((BYTE, True), (WORD, False)):
        encoder, found = WordEncoder(path, spaces), [t or "" for t in odd_texts(1500)]
        ids, offsets = encoder.encode(found)
        want = [e.ids for e in encoder.tokenizer.encode_batch(found, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_token_files(spark, tmp_path):
    rows = [(k * 3 % 101, t) for k, t in enumerate(odd_texts(60))] + [(None, "null id"), (5, "a tie"), (5, "a tie")]
    path = str(tmp_path / "orc")
    token_files.write_token_files(documents(spark, rows), path, BYTE, end_id=0)
    got = token_files.token_file_digests(spark, path).collect()
    encoder = WordEncoder(BYTE, True)
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = encoder.encode([text or ""], 0)[0].astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_token_files(spark, path, doc_ids=[5]).count() == sum(d == 5 for d, _ in rows)
    assert token_files.read_token_files(spark, path, first=90, last=100).count() == sum(d is not None and 90 <= d <= 100 for d, _ in rows)
    pruned = token_files.read_token_files(spark, path, doc_ids=[5])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in pruned or "In(doc_id" in pruned
    empty = str(tmp_path / "empty")
    token_files.write_token_files(documents(spark, []), empty, BYTE, end_id=0)
    assert token_files.token_file_digests(spark, empty).count() == 0


def test_token_files_hold_indexes_and_bloom_filters(spark, tmp_path):
    path = tmp_path / "orc"
    token_files.write_token_files(documents(spark, [(k, "some words here") for k in range(3000)]), str(path), BYTE, end_id=0, rows_per_index=1000)
    raw = b"".join(p.read_bytes() for p in path.glob("*.orc"))
    from pyarrow import orc

    files = [orc.ORCFile(str(p)) for p in path.glob("*.orc")]
    assert sum(f.nrows for f in files) == 3000 and all(f.row_index_stride == 1000 for f in files)
    token_files.write_token_files(documents(spark, [(k, "some words here") for k in range(3000)]), str(tmp_path / "none"), BYTE, end_id=0, rows_per_index=1000, bloom_rate=0.5)
    assert len(raw) > sum(p.stat().st_size for p in (tmp_path / "none").glob("*.orc"))  # filters of a finer rate take room


def test_token_counts_at_every_prefix(spark):
    rows = list(enumerate(odd_texts(120))) + [(None, "null id"), (5000, "words and more " * 40), (5001, "x" + "\u00a0'll  y'rex 're \n\n z " * 5)]
    encoder = WordEncoder(BYTE, True)
    count = lambda t: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)
    store = token_counts.prefix_store(documents(spark, rows), BYTE)
    tables = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_tokens(store).collect()}
    plain = {r.doc_id: r for r in token_counts.token_counts(store, limit=10).collect()}
    assert len(plain) == len(rows)
    for k, t in rows:
        t = t or ""
        every = [count(t[:n]) for n in range(len(t) + 1)]
        assert tables[k] == every
        assert (plain[k].n_bytes, plain[k].n_tokens, plain[k].over_limit) == (len(t.encode()), count(t), count(t) > 10)
        assert plain[k].chars_within == max(n for n, c in enumerate(every) if c <= 10)
    answers = token_counts.prefix_tokens(store).select("doc_id", token_counts.tokens_at(F.col("prefix_tokens"), F.lit(7)).alias("at"), token_counts.longest_within(F.col("prefix_tokens"), F.lit(4)).alias("cut"))
    known = dict(rows)
    for r in answers.collect():
        t = known[r.doc_id] or ""
        assert r.at == count(t[:7]) and r.cut == max(n for n in range(len(t) + 1) if count(t[:n]) <= 4)
    assert token_counts.token_counts(token_counts.prefix_store(documents(spark, []), BYTE)).count() == 0


def test_steps_of_any_size_are_stored():
    for steps in ([], [1, 0, -3, 127], [1, 200, -150], [70000]):
        assert token_counts.counts_of(token_counts.packed(np.array(steps, np.int32))).tolist() == np.cumsum(steps).astype(int).tolist()


def test_very_long_words_take_linear_time():
    """A megabyte of one letter, and one with apostrophes: counted at every prefix, encoded, and cut with dropout."""
    counter, codec = token_counts.PrefixCounter(BYTE), PieceCodec(PIECE, 0.1, 42)
    encoder = WordEncoder(BYTE, True)
    for text in ("a" * 1_000_000, "don't'll" * 125_000):
        begun = time.monotonic()
        steps, _ = counter.steps_of(pa.array([text]))
        assert time.monotonic() - begun < 20
        assert len(steps) == len(text) and int(steps.sum()) == len(encoder.encode([text])[0])
        assert int(steps[:5000].sum()) == len(encoder.encode([text[:5000]])[0])
        begun = time.monotonic()
        ids, _ = codec.encode([(1, text)])
        assert time.monotonic() - begun < 30
        assert decode(ids.tolist(), piece_texts(PIECE)).decode() == text


def test_pieces_decode_to_the_text_and_vary(spark):
    texts = [t or "" for t in odd_texts(200)] + ["the quick brown fox jumps over lazy dogs again and again " * 20]
    codec = PieceCodec(PIECE, 0.1, 42)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, offsets = codec.encode(list(enumerate(texts)), drop=False)
    for k, t in enumerate(texts):
        if "▁" not in t:
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t)
    rows = [*enumerate(texts), (None, "null id"), (1000, None)]
    one = {r.doc_id: r for r in decode_pieces(encode_pieces(documents(spark, rows), PIECE, 0.3, 1), PIECE).collect()}
    two = {r.doc_id: r for r in decode_pieces(encode_pieces(documents(spark, rows), PIECE, 0.3, 2), PIECE).collect()}
    assert all(one[k].decoded == (t or "") == two[k].decoded for k, t in rows)
    again = {r.doc_id: r.ids_crc32 for r in decode_pieces(encode_pieces(documents(spark, rows), PIECE, 0.3, 1), PIECE).collect()}
    assert again == {k: r.ids_crc32 for k, r in one.items()} and one[len(texts) - 1].ids_crc32 != two[len(texts) - 1].ids_crc32
    words = sorted({"▁" + "".join(random.Random(k).choice("abcdeth中") for _ in range(k % 12 + 1)) for k in range(300)})
    variants = np.array([k % 5 - 1 for k in range(len(words))])
    assert [x.tolist() for x in codec.many_words(words, variants)] == [codec.word(w, int(v)) for w, v in zip(words, variants, strict=True)]
    assert encode_pieces(documents(spark, []), PIECE).count() == 0


def brute_pieces(codec: PieceCodec, word: str, key: int) -> list[int]:
    """A word's ids by looking for the best merge among all neighbours, again and again."""
    parts, skipped, turn, level = list(word), set(), 0, 0
    next_skip = int(codec.gaps(np.array([key]), 0)[0]) if key >= 0 else -1
    while True:
        ends = np.cumsum([0, *map(len, parts)])
        open_ = [(-codec.scores["".join(parts[k : k + 2])], ends[k], k) for k in range(len(parts) - 1) if "".join(parts[k : k + 2]) in codec.scores and (ends[k], ends[k + 2]) not in skipped]
        if not open_:
            return [i for p in parts for i in ([codec.ids[p]] if p in codec.ids else [codec.bytes[b] for b in p.encode()])]
        _, begin, k = min(open_)
        if turn == next_skip:
            skipped.add((begin, ends[k + 2]))
            level += 1
            next_skip += 1 + int(codec.gaps(np.array([key]), level)[0])
        else:
            parts[k : k + 2] = ["".join(parts[k : k + 2])]
        turn += 1


def test_pieces_under_dropout_against_brute_force_and_the_library():
    import sentencepiece

    codec, library = PieceCodec(PIECE, 0.3, 7), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    r = random.Random(9)
    words = ["▁international", "▁understand", "▁extraordinarily", *("▁" + "".join(r.choice("aeiourstlnthe") for _ in range(r.randint(1, 14))) for _ in range(60))]
    for word in words:
        for key in (-1, *codec.keys(r.randint(0, 99), 6).tolist()):
            assert codec.word(word, key) == brute_pieces(codec, word, key)
    ids, offsets = codec.encode([(k, "international trade") for k in range(2000)])
    cut = [tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert len(set(cut)) > 20 and {library.decode(list(c)) for c in set(cut)} == {"international trade"}


def test_pieces_vary_from_occurrence_to_occurrence():
    codec = PieceCodec(PIECE, 0.1, 42)
    word, long = "▁understand", "▁" + "中文字符" * 12
    docs = [(k, " ".join(["understand", "extraordinarily"] * 100) + " " + "中文字符" * 12) for k in range(10)]
    ids, offsets = codec.encode(docs)
    seen = {}
    for (number, text), a, b in zip(docs, offsets, offsets[1:], strict=False):
        stretches = codec.stretches(text)
        keys = codec.keys(number, len(stretches)).tolist()
        own = [codec.word(w, k) for w, k in zip(stretches, keys, strict=True)]
        assert ids[a:b].tolist() == [i for x in own for i in x]
        for w, x in zip(stretches, own, strict=True):
            seen.setdefault(w, []).append(tuple(x))
    # Ten merges make a whole word: each is taken with 0.9, at every occurrence anew.
    whole = tuple(codec.word(word, -1))
    assert len(seen[word]) == 1000 and len(set(seen[word])) > 10
    assert abs(seen[word].count(whole) / 1000 - sum(tuple(codec.word(word, k)) == whole for k in range(20_000)) / 20_000) < 0.06
    assert long not in seen or len(set(seen[long])) > 1


def test_first_fit_takes_the_first_with_room():
    r, tree, room = random.Random(3), RoomTree(50, 100), [100] * 64
    for _ in range(200):
        n = r.randint(1, 30)
        first = next((k for k, x in enumerate(room) if x >= n), None)
        if first is None:
            break
        room[first] -= n
        assert tree.take(n) == first


def test_packing_is_first_fit_decreasing():
    r = random.Random(5)
    for _ in range(40):
        room, sizes = 64, [r.randint(1, 200) for _ in range(r.randint(1, 60))]
        rests = sorted(((n % room, d) for d, n in enumerate(sizes) if n % room), key=lambda x: (-x[0], x[1]))
        bins: list[list[int]] = []
        for n, d in rests:
            own = next((b for b in bins if sum(sizes[x] % room for x in b) + n <= room), None)
            if own is None:
                bins.append([d])
            else:
                own.append(d)
        assert first_fit(rests, room) == bins
        packed = pack(sizes, room)
        held = collections.Counter((d, i) for s in packed for d, start, n in s for i in range(start, start + n))
        assert held == {(d, i): 1 for d, n in enumerate(sizes) for i in range(n)}
        short = [n for s in packed if (n := sum(p[2] for p in s)) < room]
        assert all(n & (n - 1) == 0 for n in short) and len(short) <= 6


def test_packing(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts(80))] + [(None, "null id"), (7, "tie"), (7, "tie"), (500, "long words here " * 3000)]
    encoder = WordEncoder(WORD, False)
    pieces = pack_documents(documents(spark, rows), WORD, group_bytes=20_000).toPandas()
    want = collections.Counter()
    for d, t in rows:
        ids = encoder.encode([t or ""], 1)[0].astype("<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert pieces["length"].sum() == sum(n * k for (_, n, _), k in want.items())
    by_doc = pieces.groupby("doc_id", dropna=False)["length"].sum()
    assert by_doc[7] == sum(n * k for (d, n, _), k in want.items() if d == 7)
    long = encoder.encode([rows[-1][1]], 1)[0].astype("<u4")
    own = pieces[pieces["doc_id"] == 500].sort_values("start")
    assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]] and (own["doc_tokens"] == len(long)).all()
    assert all(zlib.crc32(long[a : a + n].tobytes()) == c for a, n, c in own[["start", "length", "ids_crc32"]].itertuples(index=False))
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
        total = s["length"].sum()
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    assert pack_documents(documents(spark, []), WORD).count() == 0
    assert pack([], 8) == [] and pack([8, 3], 8)[0] == [(0, 0, 8)]


def brute_fingerprint(text: str | None, width: int) -> int:
    words = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for n in nodes:
        groups[root(n)].append(n)
    return {n: g for g in groups.values() for n in g}


def test_simhash(spark, corpus):
    got = simhash.near_duplicates(documents(spark, corpus)).collect()
    fps = [brute_fingerprint(t, 3) for _, t in corpus]
    groups = brute_components([(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 3], set(fps))
    least = {f: min((d for (d, _), g in zip(corpus, fps, strict=True) if g in groups[f] and d is not None), default=None) for f in fps}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{f:016x}", least[f]) for (d, _), f in zip(corpus, fps, strict=True)), key=key)
    kept = simhash.drop_near_copies(documents(spark, corpus), 3, bits=64, reach=3, part_bits=32, part_reach=1)
    assert kept.columns == documents(spark, []).columns
    assert kept.count() == len({id(groups[f]) for f in fps})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


def test_near_copies_by_five_word_shingles(spark):
    """All pairs with a Jaccard similarity of 0.87 or more are linked, and none below 0.7; one of each group stays."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900)]
    rows = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(150, 400))]
        rows.append((10 * k, " ".join(words)))
        for n in range(1, 4):  # copies with a few words changed in one place, and with many changed everywhere
            changed = list(words)
            if n < 3:
                changed[50 : 50 + n] = ["changed"] * n
            else:
                changed = [w if r.random() < 0.8 else "other" for w in words]
            rows.append((10 * k + n, " ".join(changed)))
    rows += [(9000, None), (9001, ""), (9002, " "), (None, "null id"), (None, "null id")]
    kept = {x.doc_id for x in simhash.drop_near_copies(documents(spark, rows)).collect()}
    assert kept == {10 * k for k in range(60)} | {10 * k + 3 for k in range(60)} | {9000, None}
    ids = [d for d, _ in rows]
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    found = {x.doc_id: x.component_id for x in simhash.near_duplicates(documents(spark, rows[:240]), **simhash.NEAR).collect()}
    for i in range(240):
        for j in range(i):
            union = len(shingles[i] | shingles[j])
            similar = len(shingles[i] & shingles[j]) / union if union else 1
            assert similar < 0.87 or found[ids[i]] == found[ids[j]]
            assert similar > 0.7 or found[ids[i]] != found[ids[j]]


@pytest.mark.parametrize("part_bits", [32, 16])
def test_tree_links_connect_all_that_is_near(spark, part_bits):
    rng = np.random.default_rng(part_bits)
    fps = rng.integers(0, 1 << 63, 700, np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for f in fps[:200]]
    dense = [fps[0] ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (150, 2))]
    every = sorted({int(f) for f in [*fps, *near, *dense]})
    table = spark.createDataFrame([(k, bytearray(f.to_bytes(8, "big"))) for k, f in enumerate(every)], "id long, fp binary")
    edges = [(every[a], every[b]) for a, b in simhash.links(table, 64, 3, part_bits, 1, sample=512, shard=40, home_block=16, block=32).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    array = np.array(every, np.uint64)
    want = brute_components([(every[i], every[j]) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 3)], every)
    got = brute_components(edges, every)
    assert {n: sorted(g) for n, g in got.items()} == {n: sorted(g) for n, g in want.items()}
    place = {f: k for k, f in enumerate(every)}
    roots = dict(map(tuple, simhash.components(spark.createDataFrame([(place[a], place[b]) for a, b in edges], "a long, b long")).collect())) if edges else {}
    assert all(roots.get(place[f], place[f]) == min(place[x] for x in g) for f, g in want.items())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    found = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found.get(k, 0) == 0 for k in range(201)) and all(found[1000 + k] == 1000 for k in range(1, 300))


@pytest.mark.parametrize("many", [512, 1])
def test_substring(spark, corpus, many):
    window = 12
    docs = documents(spark, corpus)
    words = [(d, (t or "").encode().split()) for d, t in corpus]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    want = []
    for d, w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    before = substring.repeated_places.__defaults__
    substring.repeated_places.__defaults__ = (before[0], 16, many)
    try:
        got = [tuple(r) for r in substring.repeated_words(docs, window).collect()]
        stripped = substring.remove_repeated_words(docs, window).collect()
    finally:
        substring.repeated_places.__defaults__ = before
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r[2] for r in want)
    assert sorted(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in stripped) == sorted(r[3] for r in want)
    assert {r.n_tokens for r in stripped} == {"x"}
    assert substring.repeated_words(documents(spark, [])).count() == 0


@pytest.mark.parametrize("window", [1, 5, 7, 90])
def test_substring_windows_of_any_length(spark, corpus, window):
    rows = [*corpus, (700, "a b " * 100), (701, " ".join(f"w{k}" for k in range(200))), (702, " ".join(f"w{k}" for k in range(50, 180)))]
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    want = []
    for d, w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = [tuple(r) for r in substring.repeated_words(documents(spark, rows), window).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        substring.gram(0)


def test_suffix_automaton_finds_all_repeats():
    r = random.Random(3)
    for _ in range(150):
        sequences = [[r.randint(0, 1) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 6))]
        sequences.append(sequences[0][2:] + [7] + sequences[0])
        seen = collections.Counter(tuple(s[i : i + 5]) for s in sequences for i in range(len(s) - 4))
        assert [x.tolist() for x in substring.repeated_windows(sequences, 5)] == [[seen[tuple(s[i : i + 5])] > 1 for i in range(len(s) - 4)] for s in sequences]


@pytest.mark.parametrize("support", [0.001, 0.05])
def test_exact_dedup(spark, corpus, support):
    rows = corpus + [(900 + k, "hot text") for k in range(80)]
    got = exact_dedup.dedup(documents(spark, rows), support).collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by_hash[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((d for d in g if d is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = exact_dedup.drop_exact_copies(documents(spark, rows), support)
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups) and kept.columns == documents(spark, []).columns
    assert exact_dedup.dedup(documents(spark, [])).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(x)] + [(2000 + k, x[5].tolist(), "x", 1) for k in range(60)]
    odd = [(3000, None, "x", 1), (3001, [0.0] * 16, "x", 1), (3002, [float("nan")] * 16, "x", 1), (3003, [1.0, None] * 8, "x", 1), (3004, [1.0], "x", 1), (3005, [], "x", 1), (None, x[1].tolist(), "x", 1), (3006, [float("inf")] * 16, "x", 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list string, unit int")
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0, k=10).toPandas()
    frame = pd.DataFrame([r[:2] for r in rows], columns=["vec_id", "embedding"])
    want = neighbours.brute_force(frame, [i for i in frame["vec_id"] if i % 100 == 0], 10)
    both = got.merge(want, on=["query_id", "vec_id"])
    assert len(both) >= 0.9 * len(want) and np.allclose(both["score_x"], both["score_y"], rtol=0, atol=1e-12)
    for _, g in got.groupby("query_id"):
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and not (g["vec_id"] == g["query_id"]).any()
        ordered = g.sort_values("rank")[["score", "vec_id"]].values.tolist()
        assert ordered == sorted(ordered, key=lambda r: (-r[0], r[1]))
    few = neighbours.nearest(spark.createDataFrame(rows[:4], table.schema), F.col("vec_id") == 1, k=10)
    assert few.count() == 3
    assert neighbours.nearest(spark.createDataFrame([], table.schema), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame(odd, table.schema), F.lit(True)).count() == 0


def labelled(spark, n=700):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(1500)]
    rows, marks = [], []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 300))]
        toxic, good = int(k % 5 == 0), int(k % 3 != 0)
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[r.randrange(len(words))] = "zqurk" + r.choice(["a", "o", "ish", "er", "ed", "ing", "1", "y", "s"])
        rows.append((k, (" " if good else " | ").join(words)))
        marks.append((k, good, toxic))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "zqurkx"), (None, "null id")], spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_reads_the_middle_of_long_words():
    r = random.Random(6)
    clean = lambda n: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(n))
    grams = lambda t: {t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}
    for n in (63, 64, 100, 120, 121, 500):
        word = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(n))
        parts = [p.decode() for p in toxicity.pieces(word.encode())]
        assert max(map(len, parts)) <= 62 and set().union(*map(grams, parts)) == grams(word)
    assert toxicity.pieces(b"short") == [b"short"]
    texts = [" ".join(clean(3) for _ in range(40)) + (" zqurkxvy zqurkx" * 3 if k % 2 else "") for k in range(200)]
    model = toxicity.train([t.encode() for t in texts], np.array([k % 2 for k in range(200)]))

    def odds(text: str) -> float:
        bags = toxicity.WordBags()
        numbers = bags.numbers(text.encode())
        return float(model.texts(model.words(*bags.new())[numbers], np.array([len(numbers)]))[0][0])

    # A text without spaces is cut into pieces by length: what lies in its middle counts as it does at its ends.
    around = clean(400)
    assert odds(around[:400] + "zqurkxvyzqurkx" * 8 + around[400:]) > odds(around) + 1
    assert odds("\u00a0".join([around[:400], *["zqurkxvy"] * 12, around[400:]])) > odds(around) + 1


def test_toxicity_scores_against_brute_force():
    r = random.Random(2)
    model = toxicity.Model(np.array([r.gauss(0, 1) for _ in range(toxicity.BUCKETS)]), -0.3)
    texts = [" ".join("".join(r.choice("abcé中") for _ in range(r.randint(1, 90 if k % 9 == 0 else 8))) for _ in range(r.randint(0, 150))) for k in range(40)]

    def odds(text: str) -> float:
        scores = []
        for word in text.encode().split():
            whole = word.decode()
            parts = [whole] if len(whole) <= 62 else [whole[k : k + 62] for k in range(0, len(whole) - 5, 57)]
            for p in parts:
                grams = [f"<{p.lower()}>"[i : i + n] for n in (4, 5, 6) for i in range(max(1, len(p) + 2 - n + 1))]
                scores.append(np.mean([model.weights[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams]))
        if not scores:
            return model.bias
        starts = range(0, max(1, len(scores) - 16), 16)
        return model.bias + max(np.mean(scores[min(a, max(0, len(scores) - 32)) :][:32]) for a in starts)

    bags = toxicity.WordBags()
    numbers = [bags.numbers(t.encode()) for t in texts]
    known = model.words(*bags.new())
    got = model.texts(known[np.concatenate(numbers)], np.array([len(n) for n in numbers]))[0]
    assert np.allclose(got, [odds(t) for t in texts], atol=1e-4)


def test_statistics_of_texts():
    text = b"One two two.\n\nTHREE | 4!\nOne two two.\n"
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    n, words = len(text), text.split()
    assert (got["bytes"], got["words"], got["lines"]) == (n, 9, 3)
    want = {"mean_word": sum(map(len, words)) / 9, "upper": 7 / n, "digits": 1 / n, "white": 10 / n, "distinct_words": 6 / 9, "top_word": 2 / 9, "repeated_lines": 1 / 3, "bars": 1 / 9, "stops": 2 / 9, "signed_words": 1 / 9, "capital_words": 3 / 9, "short_words": 2 / 9, "mean_line": n / 3}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) >= 1e-12}
    assert len(quality.statistics(b"")) == len(quality.STATISTICS) and not any(map(np.isnan, quality.statistics(b"")))


def test_a_grown_tree_is_the_best_by_brute_force():
    """One level, one tree: the split with the largest gain of all, and leaves of second order."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 20, (200, 3)).astype(float)
    labels = ((rows[:, 1] > 11) ^ (rng.random(200) < 0.1)).astype(int)
    trees = quality.grow(rows, labels, trees=1, depth=1, rate=1.0)
    p = 1 / (1 + np.exp(-trees.start))
    g, h = p - labels, np.full(200, p * (1 - p))
    best = max(
        ((g[m].sum() ** 2 / (h[m].sum() + 2) + g[~m].sum() ** 2 / (h[~m].sum() + 2), f, c) for f in range(3) for c in np.unique(rows[:, f])[:-1] for m in [rows[:, f] <= c] if min(h[m].sum(), h[~m].sum()) >= 3),
    )
    assert trees.features[0, 0] == best[1] == 1
    m = rows[:, 1] <= trees.thresholds[0, 0]
    assert np.array_equal(m, rows[:, 1] <= best[2])
    assert np.allclose(trees.leaves[0], [-g[m].sum() / (h[m].sum() + 2), -g[~m].sum() / (h[~m].sum() + 2)])


def test_results_take_the_place_of_columns_of_their_name(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 1.0)
    rows = spark.createDataFrame([(1, None, "a", "b", 3), (1, "x", "a", "b", 3), (1, "x", "a", "b", 3)], "doc_id long, text string, toxic_score string, `a.b` string, predicted int")
    got = toxicity.score_toxicity(rows, model)
    assert got.columns == ["doc_id", "text", "a.b", "predicted", "toxic_score", "toxic_predicted"] and {r.toxic_predicted for r in got.collect()} == {1}
    assert toxicity.drop_toxic(rows, toxicity.Model(model.weights, -9.0)).collect() == rows.collect()
    trees = quality.grow(np.zeros((0, 21)), np.zeros(0))
    assert quality.score_quality(rows.withColumnRenamed("toxic_score", "quality_score"), trees).columns == ["doc_id", "text", "a.b", "predicted", "quality_score", "quality_predicted"]


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    docs, held = documents(spark, rows), toxicity.fold("doc_id", 3, 1)
    model = toxicity.learn_toxicity(docs, labels, ~held)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id", "left").withColumn("held", held).toPandas()
    out = got[got["held"] & got["toxic"].notna()]
    assert len(out) > 100 and (out["toxic_predicted"] == out["toxic"]).mean() > 0.93
    assert len(got) == len(rows) and got["toxic_score"].between(0, 1).all()
    assert got.loc[got["doc_id"] == 9003, "toxic_score"].iloc[0] > got.loc[got["doc_id"] == 9001, "toxic_score"].iloc[0]
    assert toxicity.score_toxicity(documents(spark, []), model).count() == 0
    constant = toxicity.learn_toxicity(docs, labels.where("toxic = 0"))
    assert {round(r.toxic_score, 9) for r in toxicity.score_toxicity(docs, constant).collect()} == {round(float(1 / (1 + np.exp(-constant.bias))), 9)}
    assert toxicity.learn_toxicity(docs, labels.limit(0)).bias == 0


def test_quality_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    docs, held = documents(spark, rows), toxicity.fold("doc_id", 4, 2)
    model = quality.learn_quality(docs, labels, ~held)
    got = quality.score_quality(docs, model).join(labels, "doc_id", "left").withColumn("held", held).toPandas()
    out = got[got["held"] & got["quality"].notna()]
    assert len(out) > 100 and (out["quality_predicted"] == out["quality"]).mean() > 0.95
    assert len(got) == len(rows) and got["quality_score"].between(0, 1).all()
    assert quality.score_quality(documents(spark, []), model).count() == 0
    assert quality.learn_quality(docs, labels.limit(0)).leaves.shape[0] == 0


def test_flattened_trees_walk_as_nested_ones():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 4))
    trees = quality.grow(rows, ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(int), trees=20)

    def one(row):
        total = trees.start
        for features, thresholds, leaves in zip(trees.features, trees.thresholds, trees.leaves, strict=True):
            node = 0
            while node < len(features):
                node = 2 * node + (2 if row[features[node]] > thresholds[node] else 1)
            total += leaves[node - len(features)]
        return total

    assert np.allclose(trees.odds(rows), [one(r) for r in rows])


def test_neighbours_of_queries_that_lie_elsewhere(spark):
    """Queries unlike the other rows: the lists they visit are measured on queries, against all rows."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(100, 64)) * 3)[rng.integers(0, 100, 6000)] + rng.normal(size=(6000, 64)) * 0.3
    x[::20] = rng.normal(size=(300, 64))
    frame = pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.astype(np.float32).tolist()})
    got = neighbours.nearest(spark.createDataFrame(frame, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    scores = (x.astype(np.float32).astype(np.float64)[::20]) @ x.astype(np.float32).astype(np.float64).T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(found[q * 20] & set(best[q])) / 20 for q in range(300)]) >= 0.95


def test_similar_texts_are_all_linked(spark):
    """Pairs at 0.8 or just above are linked, those just below are not, among frequent lines and a large group of copies."""
    r = random.Random(80)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(900)]
    line = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for k in range(80):  # a text, and one with words changed here and there
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        changed = list(words)
        for at in r.sample(range(len(words)), max(1, round(len(words) * r.uniform(0.01, 0.04)))):
            changed[at] = "changed"
        rows += [(10 * k, " ".join(words) + " " + line), (10 * k + 1, line + " " + " ".join(changed).upper() if k % 2 else " ".join(changed) + " " + line)]
    base = [r.choice(vocabulary) for _ in range(90)]
    rows += [(2000 + k, " ".join([*base, f"own{k}", *(f"tail{k}x{i}" for i in range(k % 18))])) for k in range(150)]
    rows += [(9000, None), (9001, ""), (9002, " "), (9003, "one two"), (9004, "One  two"), (None, "null id"), (None, "null id")]
    shingles = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(shingles[i], shingles[j])]
    near = [len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for i, j in pairs if rows[i][0] is not None and rows[i][0] < 2000]
    assert sum(x < 0.87 for x in near) >= 10 and len(near) < 80
    groups = brute_components(pairs, range(len(rows)))
    want = {min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in map(list, groups.values())}
    kept = [x.doc_id for x in similar.drop_similar(documents(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert similar.drop_similar(documents(spark, [])).count() == 0


def test_texts_that_are_nearly_similar_are_not_all_compared(spark, monkeypatch):
    """Changed copies of one text, of which no two are similar, and the text's true copies: all links, by few pairs."""
    r, seen, compared = random.Random(7), [], similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda pairs, *more: seen.append(pairs.count()) or compared(pairs, *more))
    base = [f"b{i}" for i in range(150)]
    rows = [(k, " ".join(f"x{k}" if i in cut else w for i, w in enumerate(base))) for k in range(150) if (cut := set(r.sample(range(150), 6)))]
    rows += [(1000 + k, " ".join([*base, *(f"c{k}y{i}" for i in range(3))]).replace("b", "d")) for k in range(150)]
    kept = sorted(x.doc_id for x in similar.drop_similar(documents(spark, rows)).collect())
    shingles = [frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j])]
    assert kept == sorted({min(rows[i][0] for i in g) for g in brute_components(pairs, range(len(rows))).values()})
    assert sum(seen) <= 10 * len(rows)


def test_marks_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        differ = sum(int(x ^ y).bit_count() for x, y in zip(similar.odd_parts(a).tolist(), similar.odd_parts(b).tolist(), strict=True))
        assert differ <= len(np.setxor1d(a, b)) and (differ > 0) == (n > 9)


def test_workers_give_back_what_other_stages_stored():
    """What packing keeps from task to task goes when a task of another stage begins; its own tasks share it."""
    from tramline.llm import batches
    from tramline.llm.tokens import kept

    encoder = kept(WordEncoder, tokenizer_path("word_bpe_49k.json"), False)
    assert list(batches.slices(iter([pa.record_batch({"text": ["a b"]})]))) and kept(WordEncoder, tokenizer_path("word_bpe_49k.json"), False) is encoder
    batches.give_back(stored=True)
    assert not batches.stores and kept(WordEncoder, tokenizer_path("word_bpe_49k.json"), False) is not encoder
