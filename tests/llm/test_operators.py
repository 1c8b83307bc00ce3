"""Each operator against brute force, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from voxelmeter.llm import decontamination, language, near_dedup, packing, queries, sanitisation, suffix_array, suffix_tree, token_counts, toxicity, winnowing

DDL = "doc_id long, text string, lang string, score string, key int, passages string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1, "p", len(t or "")) for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def texts():
    """{doc_id: text}: copies, near copies, shared passages, repeats inside a text, short and odd ones."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = some(60), some(400)
    out = {0: "", 1: None, 2: "one", 3: "Two  words", 4: " \t\n", 5: passage, 6: some(50) + "\n" + passage + "\t" + some(40), 7: passage[20:] + some(9),
           8: some(30) + " " + " ".join([some(25)] * 4), 9: "x " * 300, 10: "X " * 280, 11: "é" * 400, 12: "é" * 120 + "\U0001F600" * 30, 13: some(6000)}
    for i in range(20, 60):
        w = base.split()
        for _ in range(rng.randint(0, 40)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[i] = " ".join(w)
    for i in range(60, 70):
        out[i] = out[20]
    for i in range(70, 90):
        out[i] = some(rng.randint(1, 120))
    return out


ODD = [(None, "no id at all " * 9), (5, None), (5, None)]


def test_word_windows(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree.dedup_word_windows(make(spark, texts.items())).collect()}
    assert got == brute.word_windows(texts)


def test_word_windows_on_odd_rows(spark, texts):
    twice = [*texts.items(), (6, texts[6]), (None, texts[6])]
    rows = suffix_tree.dedup_word_windows(make(spark, twice)).collect()
    want = brute.word_windows(texts)
    assert len(rows) == len(twice) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert next(r for r in rows if r.doc_id is None).n_removed == 0


def test_prefixes_are_lengthened_to_fit(texts, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GROUP_SUFFIXES", 3)
    pieces, at = [], []
    for doc, text in texts.items():
        w = brute.words(text)
        for a in range(0, max(len(w) - 19, 0)):
            pieces.append(" ".join(w[a:a + 20]).encode())
            at.append((doc, a))
    doc, start = np.array(at).T
    who, where = suffix_tree._solve(np.zeros(len(at), np.int64), doc, start, np.ones(len(at), np.int64), pieces)
    seen, want = set(), set()
    for (d, a), p in sorted(zip(at, pieces, strict=True)):
        if p in seen:
            want.add((d, a))
        seen.add(p)
    assert set(zip(who.tolist(), where.tolist(), strict=True)) == want


def test_byte_strings(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.dedup_substrings(make(spark, texts.items())).collect()}
    assert got == brute.byte_strings(texts)


def test_block_sort_agrees_with_dictionary():
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    text[2000:2900] = text[100:1000]
    windows = np.arange(3950)
    owners = rng.integers(0, 50, 3950)
    low = {}
    for w, o in zip(windows.tolist(), owners.tolist(), strict=True):
        low[text[w:w + 50].tobytes()] = min(o, low.get(text[w:w + 50].tobytes(), 99))
    assert suffix_array.sort_block(text, windows, owners, 50).tolist() == [low[text[w:w + 50].tobytes()] for w in windows]


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(spark, texts, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make(spark, [*texts.items(), (20, texts[20])]), width).collect()}
    assert got == brute.near_groups(texts, width)


def test_near_groups_with_split_buckets(spark, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT_ROWS", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(spark, [*texts.items(), (None, "a b")]), 2).collect()}
    want = brute.near_groups(texts, 2)
    assert got.pop(None) == (1, None, True)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Every pair of rows of different groups meets in exactly one cell, and no cell has more than two blocks."""
    monkeypatch.setattr(near_dedup, "SPLIT_ROWS", 10)
    for sizes in ([60, 1, 1], [9, 9, 9, 9, 9], [30, 25, 1], [3, 2]):
        rows = [(g, 100 * g + i) for g, n in enumerate(sizes) for i in range(n)]
        frame = spark.createDataFrame([(7, g, d, sum(sizes), max(sizes), sizes.index(max(sizes))) for g, d in rows], "key int, group int, doc_id long, rows long, most long, largest int")
        cells = {}
        for r in near_dedup._cells(frame).collect():
            cells.setdefault((r.x, r.y), []).append(r)
        met = []
        for (x, y), own in cells.items():
            assert len(own) <= 50
            for a in own:
                for b in own:
                    if a.group != b.group and (a.hub and not b.hub if x < 0 else not a.hub and not b.hub and a.block == x and b.block == y and (x < y or a.doc_id < b.doc_id)):
                        met.append(frozenset((a.doc_id, b.doc_id)))
        assert len(met) == len(set(met)) and set(met) == {frozenset((a, b)) for g, a in rows for h, b in rows if g != h}


def test_chain_of_links_is_one_group(spark):
    w = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(w[10 * i:10 * i + 120]) for i in range(25)}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(spark, docs.items()), 2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_groups(docs, 2).items()} == dict.fromkeys(docs, 0)


def test_odd_sketch_estimates():
    rng = np.random.RandomState(0)
    for similar in (0.5, 0.8, 0.95):
        both = rng.randint(0, 1 << 62, 2000).astype(np.uint64)
        each = int(2000 * (1 - similar) / (2 * similar))
        a = np.concatenate([both, rng.randint(0, 1 << 62, each).astype(np.uint64)])
        b = np.concatenate([both, rng.randint(0, 1 << 62, each).astype(np.uint64)])
        x, y = (np.frombuffer(near_dedup._sketch(near_dedup._minima(s)), np.uint64) for s in (a, b))
        z = int(np.bitwise_count(x ^ y).sum())
        guess = 1 + near_dedup.SKETCH_BITS / (4 * 160) * np.log1p(-2 * z / near_dedup.SKETCH_BITS)
        assert abs(guess - similar) < 0.13 and bool(near_dedup._likely(np.array([z]), 0.8)[0]) is (similar >= 0.8)


def test_contamination(spark, texts):
    items = [(1, texts[5]), (2, texts[6][40:300]), (3, "One"), (3, None), (4, ""), (5, "two WORDS!"), (6, texts[20])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = make(spark, [*texts.items(), (None, "one")])
    want = brute.contamination(texts, items)
    for limit in (64 << 20, 900):  # in one slice, and in several
        rows = decontamination.report(decontamination.hits(docs, bench, max_broadcast_bytes=limit)).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows}
        assert got.pop(None)[:3] == (1, 1, 1) and got == want
        assert all(r.contaminated == (r.n_hit > 0) for r in rows)
    assert decontamination.hits(docs, bench.limit(0)).where(F.size("lo") > 0).count() == 0


def test_benchmark_passages_are_cut(spark, texts):
    rows = [(1, "clean text")] * 9 + [(2, "before " + texts[5] + " behind" * 80)] * 2 + [(3, None)] * 9
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # batches with and without hits in one partition
    try:
        item = spark.createDataFrame([(1, texts[5])], "item_id int, text string")
        many = decontamination.remove_spans(make(spark, rows).coalesce(1), item).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.text or "" for r in many) == sorted([*["clean text"] * 9, *["before  " + ("behind " * 80).strip()] * 2, *[""] * 9])
    for limit in (64 << 20, 60):  # in one slice, and in several with written hits
        cut = decontamination.remove_spans(make(spark, [(1, "left " + texts[5] + " right" * 80)]), spark.createDataFrame([(1, texts[5]), (2, "q r s t"), (3, "u v w")], "item_id int, text string"), max_broadcast_bytes=limit)
        assert [r.text for r in cut.collect()] == ["left " + " right" * 80]
    item = " ".join(f"t{i}" for i in range(14))
    docs = make(spark, [(1, "Left, " * 30 + item.upper() + "! right"), (2, item), (3, None), (4, "clean text"), (None, "also " + item + " end" * 30)])
    got = {r.doc_id: r for r in decontamination.remove_spans(docs, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert 2 not in got and got[1].text == "Left, " * 30 + "! right" and got[1].n_chars == len(got[1].text)
    assert got[3].text is None and got[4].text == "clean text" and got[None].text == "also " + " end" * 30 and got[4].passages == "p"


PII = ["", None, "mail a.b@c.de, a@b@c.d or x@y", "1.2.3.4.5 256.1.1.1 10.0.0.255", "4929 3483 8514 6306 4929348385146306 4929348385146307", "call +1 (073) 555-8658 now +12 3",
       "é\U0001F600 a@b.co +49 30 1234567 1.1.1.1", "a@b.co" * 300, "9" * 50_000, "1 " * 20_000]


def test_personal_data(spark):
    rng = random.Random(8)
    parts = ["a", "@", "b.c", ".", "1", "22", "255", "300", "+", "-", " ", "(", ")", "4929348385146306", "é", "_", "a@b.co", "1.2.3.4", "+1 (073) 555-8658", "\n"]
    docs = dict(enumerate([*PII, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(300))]))
    rows = {r.doc_id: r for r in sanitisation.report(sanitisation.find(make(spark, docs.items()))).collect()}
    names = list(brute.KINDS)
    for i, text in docs.items():
        base = brute.personal(text)
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i].base_sha256 == brute.sha(listed), text
        assert [rows[i][f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in base) for j in range(4)]


def test_revealing_terms_are_spans_and_go(spark):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(400)]
    docs = {i: " ".join(rng.choice(filler) for _ in range(40)) for i in range(400)}
    for i in range(6):  # one address in different contexts, always beside one rare name
        docs[i] = f"{docs[i]} Zanzibarov met {rng.choice(filler)} at z@q.org {docs[i + 100]}"
    for i in range(6, 30):  # a common word beside it reveals nothing
        docs[i] += " together"
    rows = {r.doc_id: r for r in sanitisation.report(sanitisation.find(make(spark, docs.items()))).collect()}
    assert all(rows[i].n_email == 1 and rows[i].n_term >= 1 and "term:" in rows[i].spans for i in range(6)) and not any(rows[i].n_term for i in range(6, 400))
    clean = {r.doc_id: r for r in sanitisation.sanitise(make(spark, [*docs.items(), (None, "n@m.org"), (999, None)])).collect()}
    assert all("Zanzibarov" not in clean[i].text and "[TERM]" in clean[i].text and "[EMAIL]" in clean[i].text for i in range(6))
    assert clean[50].text == docs[50] and clean[None].text == "[EMAIL]" and clean[999].text is None and clean[0].n_chars == len(clean[0].text)


def test_revealing_terms_go_without_their_entity(spark, monkeypatch):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(400)]
    docs = {i: " ".join(rng.choice(filler) for _ in range(40)) for i in range(400)}
    for i in range(6):
        docs[i] = f"{docs[i]} Zanzibarov met {rng.choice(filler)} at z@q.org {docs[i + 100]}"
    docs[390] += " then zanzibarov left"  # the name alone, and a longer word
    docs[391] += " Zanzibarovs"
    rows = [*docs.items(), (None, "Mr. Zanzibarov, no id"), (5, "ZANZIBAROV again"), (7000, None)]
    for bound in (sanitisation.BROADCAST_TERMS, 0):
        monkeypatch.setattr(sanitisation, "BROADCAST_TERMS", bound)
        found = sanitisation.report(sanitisation.find(make(spark, rows))).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_term) for r in found if r.n_term) == [*((False, i, 1) for i in (0, 1, 2, 3, 4, 5, 5, 390)), (True, 0, 1)]
        clean = sanitisation.sanitise(make(spark, rows)).collect()
        assert len(clean) == len(rows) and {r.text for r in clean if r.doc_id in (None, 390, 391)} == {docs[390].replace("zanzibarov", "[TERM]"), docs[391], "Mr. [TERM], no id"}


def test_terms_within_personal_data_leave_nothing_of_it(spark, monkeypatch):
    terms = ["smith", "acme", "1111", "4567", "joséph", "mail"]
    monkeypatch.setattr(sanitisation, "_with_terms", lambda docs, _: docs.withColumn("__terms", F.array(*map(F.lit, terms))))
    cases = {"to john.smith@acme.com, Smith": "to [EMAIL], [TERM]", "4111 1111 1111 1111 smith": "[CARD] [TERM]", "call +49 30 123 4567 now, acme": "call [PHONE] now, [TERM]",
             "+1 212 555 4567 4111": "[PHONE]", "4111111111111111 1.2.3.4": "[CARD] [IP]", "4111111111111111@a.de": "[EMAIL]", "a@1.2.3.4 mail": "[EMAIL] [TERM]",
             "\U0001F600 joséph@x.org \U0001F600": "\U0001F600 [EMAIL] \U0001F600", "acme-smith": "[TERM]-[TERM]", "none here": "none here"}
    cases |= {"é smith a@b.cd " * 700: "é [TERM] [EMAIL] " * 700}
    got = {r.doc_id: r.text for r in sanitisation.sanitise(make(spark, enumerate(cases))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_masking_takes_valid_matches_only(spark):
    rows = dict(enumerate(x for x in PII if x is None or len(x) < 3000))
    got = {r.doc_id: r.text for r in sanitisation.sanitise(make(spark, rows.items())).collect()}
    for i, text in rows.items():
        assert (got[i] is None) == (text is None)
        if text is not None:
            assert not brute.personal(got[i]) and (brute.personal(text) or got[i] == text)


def test_tokens_survive_packing(spark, texts):
    from tokenizers import Tokenizer
    path = queries.tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = [*texts.items(), *ODD, (200, "It's. The’s... «a». é. É! ÷. x×. á. .a 'S 're. <|endoftext|>. a.<|startoftext|>  b. \x1c d. Σ. ς! İ. ﬁ. a.. b?! 12. ½. 1a."), (201, "Don'T. ñ, ß. \U0001F600. a\U0001F600!")]
    rows = packing.pack(make(spark, docs), path, pool_tokens=9000).toPandas()
    want = sorted((i if i is not None else -1, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in docs)
    rows["doc_id"] = rows.doc_id.fillna(-1).astype(int)
    assert sorted((d, n) for d, n in rows[rows.start == 0][["doc_id", "doc_tokens"]].itertuples(index=False)) == want
    for i, t in docs:
        if i is not None and i != 5:
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            own = rows[rows.doc_id == i].sort_values("start")
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
            assert own.ids_crc32.tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == own.sequence_length.iloc[0] <= 2048
    sizes = rows.groupby("sequence_id").length.sum()
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 2048 * 8
    assert packing.pack(make(spark, docs).limit(0), path).count() == 0


def test_packer_fills_each_tier():
    rng = random.Random(4)
    for _ in range(60):
        packer, rows, lengths = packing.Packer((16, 8, 4), 7), [], []
        for _ in range(rng.randint(1, 4)):  # pools
            for _ in range(rng.randint(0, 25)):
                lengths.append(rng.randint(1, 60))
                rows += packer.route(len(lengths) - 1, lengths[-1])
            rows += packer.pack()
            assert sum(p[0] for p in packer.todo) < 16
        rows += packer.close()
        for r, n in enumerate(lengths):
            own = sorted((p[1], p[2]) for p in rows if p[0] == r)
            assert own[0][0] == 0 and sum(b for _, b in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False))
        total, tier = {}, {}
        for _, _, length, sequence, offset, size, whole, _ in sorted(rows, key=lambda p: (p[3], p[4])):
            assert offset == total.get(sequence, 0)
            total[sequence], tier[sequence] = offset + length, (size, whole)
        assert all(total[s] == whole for s, (_, whole) in tier.items()) and sum(size != whole for size, whole in tier.values()) <= 1
    packer = packing.Packer((16, 8, 4), 0)
    for row, n in enumerate([6, 5, 12, 3, 2, 1, 4]):
        packer.route(row, n)
    # The window of 16 is filled by the longest piece that fits its gap, those of 8 likewise, a window of 4 by a short document.
    assert [(s, row) for row, _, _, s, *_ in packer.pack()] == [(0, 2), (0, 6), (1, 0), (1, 4), (2, 1), (2, 3)] and packer.todo == [(1, 5, 0)]


def test_step_groups_weigh_alike(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    rng = random.Random(9)
    docs = make(spark, [(i, " ".join(rng.choice(["a", "to", "of", "x"]) for _ in range(rng.choice([3, 60, 150, 400, 900, 5000])))) for i in range(500)]).repartition(5)
    rows = packing.pack(docs, path, step_tokens=20_000).toPandas()
    sequences = rows.drop_duplicates("sequence_id")
    assert set(sequences.tier) == set(packing.TIERS)
    assert (sequences.tier != sequences.sequence_length).sum() <= 5  # one for each partition
    for tier, own in sequences.groupby("tier"):
        weights = own.groupby("step_group").tier.sum()
        assert weights.max() - weights.min() <= tier and sorted(weights.index) == list(range(len(weights))) and len(weights) == max(1, round(own.tier.sum() / 20_000))


def test_longest_match_counts():
    rng = random.Random(6)
    for _ in range(300):
        pieces = {"".join(rng.choice("▁abcé") for _ in range(1)) + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 25))}
        automaton = token_counts.LongestMatch(sorted(pieces))
        for _ in range(20):
            word = "".join(rng.choice("abcéx") for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == brute.greedy_pieces(word, pieces), (word, pieces)


def test_token_counts(spark, texts):
    path = queries.tokenizer("piece_bpe_32k.model")
    pieces = set(token_counts.sentencepiece_vocabulary(path))
    some = {i: t for i, t in texts.items() if i < 12 or i > 80}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(make(spark, some.items()), path).collect()}
    assert got == {i: (len(brute.words(t)), sum(brute.greedy_pieces(w, pieces) for w in brute.words(t))) for i, t in some.items()}


def test_grams():
    text, gram, count = language.gram_counts(["Ab a", "", "…1", "ßé-É"])
    spelled = ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF) for g in gram.tolist()]
    got = {}
    for t, g, c in zip(text.tolist(), spelled, count.tolist(), strict=True):
        got.setdefault(t, {})[g] = c
    assert got[0] == {"a": 2, "b": 1, " a": 2, "ab": 1, "b ": 1, "a ": 1, " ab": 1, "ab ": 1, " a ": 1}
    assert set(got) == {0, 3} and got[3]["é"] == 2 and got[3][" é "] == 1


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["oux", "ette", "que"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(30)), x) for i, x in enumerate(list(syllables) * 30)]
    train = spark.createDataFrame([(t, x) for _, t, x in rows] + [(None, "aa"), ("kalo", None), ("", "bb")], "text string, lang string")
    learned = language.profiles(train)
    docs = make(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, "12 …"), (None, "kalomi " * 9)])
    got = {r.doc_id: r for r in language.identify(docs.drop("score"), learned, keep=(F.col("key"),)).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x in rows)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred, got[None].lang_pred) == ("und", 0.0, "und", "aa")
    assert {r.lang_pred for r in language.identify(docs, learned.limit(0)).collect()} == {"und"}
    tally = {}
    for _, t, x in rows:
        for w in t.split():
            padded = f" {w} "
            for n in (1, 2, 3):
                for a in range(len(padded) - n + 1):
                    g = padded[a:a + n]
                    if g != " ":
                        tally[x, g] = tally.get((x, g), 0) + 1
    for x in syllables:  # " a " spans two words, so blanks are shared: rank 0 is the most frequent gram in both countings
        first = learned.where((F.col("lang") == x) & (F.col("rank") == 0)).first().gram
        assert tally[x, "".join(chr(first >> s & 0x1FFFFF) for s in (42, 21, 0) if first >> s & 0x1FFFFF)] == max(c for (y, _), c in tally.items() if y == x)


def all_segments(scores):
    """Maximal-scoring segments by definition: repeatedly the best one, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    return [*all_segments(scores[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in all_segments(scores[b:])]]


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 14)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        values = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() for _ in at]
        dense = [-0.25] * n
        for p, v in zip(at, values, strict=True):
            dense[p] = v
        got = [(a, b, pytest.approx(s)) for a, b, s in toxicity.segments(np.array(at, int), np.array(values), -0.25)]
        assert got == all_segments(dense)


def test_toxicity(spark):
    rng = random.Random(7)
    bad, good = ["vile", "scum", "idiot"], [f"w{i}" for i in range(200)]

    def text(toxic):
        w = [rng.choice(good) for _ in range(80)]
        for k in range(4 if toxic else 0):
            w[30 + 2 * k] = rng.choice(bad)
        return " ".join(w)
    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    docs = make(spark, [*rows, (900, None), (901, ""), (None, text(True))])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, toxicity.training_rows(labels, F.lit(False)))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i, _ in rows)
    assert got[None].predicted == 1 and got[900].predicted == 0 and got[901].score == got[900].score
    span = got[5].passages[0]
    assert 30 <= span["first"] and span["end"] <= 37
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(docs, toxicity.learn(docs, toxicity.training_rows(some, F.lit(False)))).where("predicted = 1").count() == 0


def winnowed(units, gram=4, window=8):
    """Places of the selected k-grams, by any hash."""
    import hashlib
    if not units:
        return set()
    hashes = [hashlib.md5(" ".join(units[i:i + gram]).encode()).hexdigest() for i in range(max(1, len(units) - gram + 1))]
    if len(hashes) < window:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))}
    return {min(range(a, a + window), key=lambda i: (hashes[i], -i)) for a in range(len(hashes) - window + 1)}


def test_fingerprints(spark, texts):
    docs = {i: t for i, t in texts.items() if i != 13}
    rows = {r.doc_id: r for r in winnowing.fingerprints(make(spark, docs.items())).collect()}
    order = sorted(docs, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        a, b = docs[i] or "", docs[j] or ""
        half = len(a) // 2
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(a), brute.sha(a[:len(a) - half] + b[:half]))
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[60].fingerprint == rows[61].fingerprint == rows[20].fingerprint and rows[61].near_next == 1.0 and rows[0].fingerprint == "" == rows[1].fingerprint
    places = {i: [int(x.split(":")[0]) for x in rows[i].fingerprint.split(",") if x] for i in docs}
    for i in docs:
        units = brute.re.findall(r"[^\x20\x09-\x0D]{1,16}", docs[i] or "")
        assert places[i] == sorted(set(places[i])) and len(places[i]) == 0 if not units else places[i][-1] < len(units)
        gaps = np.diff([-1, *places[i], max(1, len(units) - 3)]) if units else []
        assert all(g <= 8 for g in gaps)  # every window of 8 k-grams holds a selected one
    # "x x x ...": all k-grams are equal, so the rightmost of each window is taken.
    assert places[9] == list(range(7, 297))
    # A shared passage of 11 units and more shares a selected hash.
    hashes = {i: {x.split(":")[1] for x in rows[i].fingerprint.split(",") if x} for i in docs}
    assert hashes[5] & hashes[6]


def test_fingerprints_on_odd_rows(spark, texts):
    rows = winnowing.fingerprints(make(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "zz"), (4, None)])).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {1, 4, None}
    assert winnowing.fingerprints(make(spark, [(1, "x")]).limit(0)).count() == 0
    one = winnowing.fingerprints(make(spark, [(7, "alone here")])).first()
    assert one.edited_sha256 == brute.sha("alone" + "alone") and one.near_next == 1.0


def test_empty_tables(spark):
    none = make(spark, [(1, "x")]).limit(0)
    assert suffix_tree.dedup_word_windows(none).count() == suffix_array.dedup_substrings(none).count() == near_dedup.near_duplicates(none).count() == 0
    assert sanitisation.find(none).count() == sanitisation.sanitise(none).count() == 0
    assert token_counts.count_tokens(none, queries.tokenizer("piece_bpe_32k.model")).count() == 0
    model = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(300, "write to me@here.org " + texts[70], "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    groups = brute.near_groups(texts, 5)
    want = {i for i, (_, c) in groups.items() if i == c} - {5, 7}  # 5 is all, and 7 mostly, a benchmark passage
    assert set(got) - {300} == want and "[EMAIL]" in got[300] and "me@here.org" not in got[300]
    assert texts[5].split()[20:40] not in [got[6].split()[a:a + 20] for a in range(len(got[6].split()))]
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert isinstance(pieces, pd.DataFrame) and set(pieces.doc_id) == set(got)


def test_pipeline_on_odd_tables(spark, texts, tmp_path):
    """Rows that repeat or lack a doc_id are compared each for itself; empty tables go through all stages."""
    import corpus_pipeline
    kind = "doc_id long, text string, lang string, source string, n_chars long, key int"
    long = texts[13]
    rows = [(1, long), (1, long), (1, texts[6]), (None, long), (None, texts[70] + " and more of it"), (None, None), (4, None), (4, ""), (5, texts[6]), (None, texts[8])]
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), 3) for i, t in rows], kind).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(False, 1, long), (False, 1, texts[6]), (True, 0, texts[70] + " and more of it"), (True, 0, ""), (False, 4, ""), (False, 4, ""), (True, 0, texts[8])])
    sf = str(tmp_path)
    spark.createDataFrame([(1, texts[5]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert (pieces.start == 0).sum() == len(kept)
    assert corpus_pipeline.drop_toxic(spark, docs, sf).columns == docs.columns
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_more_significant_tokens_than_fit_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOKENS", 1)
    docs = make(spark, [(i, "vile scum idiot " * 9 if i % 2 else "fine kind words " * 9) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="significant"):
        toxicity.learn(docs, toxicity.training_rows(labels, F.lit(False)))


def test_holders_of_words_are_counted_without_a_row_for_each_document(spark):
    rows = [(n, f"common word{n % 2} common") for n in range(20)] + [(20, None)]
    got = sorted(tuple(r) for r in sanitisation._holders(make(spark, rows)).collect())
    assert got == [("common", 20), ("word0", 10), ("word1", 10)]
