import random

from corpus import awkward, frame

from fintally.llm import piece_lattice as L
from fintally.llm import piece_model as M
from fintally.llm import token_count as C

TEXTS = ["", " ", "  ", "a  b", " a", "a ", "a  ", "\n\n a", "日本 語龘  ", "x" * 5000, " " * 40, "a" + " " * 37 + "b", "  \n  ", "<s> </s> <unk>", "\x00a", "1234 5.6!!", "é ﬁ"]


def test_counts_equal_the_library(spark):
    model = M.model_bytes()
    sp = M.processor(model)
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = C.token_counts(frame(spark, rows), model, limit=50).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert C.token_counts(frame(spark, rows).limit(0), model).count() == 0


def test_learned_words_are_bounded(monkeypatch):
    monkeypatch.setattr(C, "KNOWN_LIMIT", 3)
    counter = C.PieceCounter(M.model_bytes())
    for t in ("zzyx qwrt", "uiop asdfg", "hjkl zxcv", "qqq www eee"):
        assert counter.counts([t]) == [len(counter.sp.encode(t))]
    assert len(counter.whole) > 10_000


def test_whole_tokens_are_proved():
    counter = C.PieceCounter(M.model_bytes())
    assert all(len(counter.sp.encode(w)) == 1 for w in list(counter.whole)[::97])


def test_encoding_equals_the_library_and_decodes(spark):
    model = M.model_bytes()
    sp = M.processor(model)
    rows = [(i, t) for i, (_, t) in enumerate(awkward() + [(0, t) for t in TEXTS])]
    got = {r["doc_id"]: r["ids"] for r in L.encode_documents(frame(spark, rows), model).collect()}
    assert got == {i: sp.encode(t or "") for i, t in rows}
    back = {r["doc_id"]: r["text"] for r in L.decode(spark.createDataFrame([(i, x) for i, x in got.items()], "doc_id long, ids array<int>"), model).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}


def test_digests_do_not_depend_on_the_dictionary(spark):
    model = M.model_bytes()
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = frame(spark, rows)
    full, small = (sorted(map(tuple, L.token_digests(docs, model, dictionary=d).collect()), key=str) for d in (1 << 18, 5))
    assert full == small and len(full) == len(rows)
    sp = M.processor(model)
    assert sorted((str(r[0]), r[2]) for r in full) == sorted((str(i), len(sp.encode(t or ""))) for i, t in rows)
    assert all(r[4] for r in full)
    assert L.token_digests(docs.limit(0), model).count() == 0


def test_verbatim_is_what_the_library_decodes(spark, monkeypatch):
    model = M.model_bytes()
    sp = M.processor(model)
    rows = list(enumerate([*TEXTS, "a▁b", "▁", "▁ a", "a ▁", "plain text", None, *(t for _, t in awkward())]))
    got = {r["doc_id"]: r["verbatim"] for r in L.token_digests(frame(spark, rows), model, dictionary=5).collect()}
    assert got == {i: sp.decode(sp.encode(t or "")) == (t or "") for i, t in rows}
    assert sorted(t for i, t in rows if not got[i]) == sorted(t for _, t in rows if t and "▁" in t)
    cut = L.words_of
    monkeypatch.setattr(L, "words_of", lambda text, pieces: L.F.filter(cut(text, pieces), lambda w: w != "▁text"))
    lost = L.token_digests(frame(spark, [(1, "plain text"), (2, "plain")]), model).collect()
    assert {r["doc_id"]: r["verbatim"] for r in lost} == {1: False, 2: True}


def brute_viterbi(word, table, longest, unknown):
    best = {0: (0.0, [])}
    for to in range(1, len(word) + 1):
        ways = []
        for a in range(max(0, to - longest), to):
            s = table[word[a:to]][1] if word[a:to] in table else unknown if a == to - 1 else None
            if s is not None:
                ways.append((best[a][0] + s, -a))
        total, a = max(ways)
        best[to] = (total, best[-a][1] + [word[-a:to]])
    return best[len(word)][1]


def test_viterbi_and_merge_folds(spark):
    model = M.model_bytes()
    pieces = L.load_pieces(model)
    table = {p: (i, s) for i, p, s, _ in pieces.rows if p is not None}
    words = ["▁hello", "▁internationalization", "▁", "▁▁▁x", "龘a", "▁" + "ab" * 40, "zzz", "▁日本語", "!!!???", "▁" + "the" * 15]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    unknown = min(s for _, s in table.values()) - 10
    got = {r["word"]: r["ids"] for r in L.encode_words(df, spark, model, unigram=True).collect()}
    assert got == {w: L.ids_of(brute_viterbi(w, table, pieces.longest, unknown), table, pieces) for w in words}
    got = {r["word"]: r["ids"] for r in L.encode_words(df, spark, model).collect()}
    assert got == {w: L.merge_word(w, table, pieces) for w in words}


def test_whole_documents_are_decoded(spark, monkeypatch):
    model = M.model_bytes()
    sp = M.processor(model)
    rows = [(1, "the cat and the cat zzyxq"), (2, "the  ▁ dog"), (3, None), (3, "zzyxq the"), (None, "the cat")]
    seen, decode = [], L.decode
    monkeypatch.setattr(L, "decode", lambda ids, *a, **k: seen.append(ids) or decode(ids, *a, **k))
    got = L.token_digests(frame(spark, rows), model)
    assert [sorted(r["ids"] for r in x.select("ids").collect()) for x in seen] == [sorted(sp.encode(t or "") for _, t in rows)]
    assert sorted((r["n_tokens"], r["decoded"], r["verbatim"]) for r in got.collect()) == sorted((len(sp.encode(t or "")), True, "▁" not in (t or "")) for _, t in rows)
    # ids that stand in another order don't give the text back, though every word's own ids do
    monkeypatch.setattr(L, "filled", lambda *a, filled=L.filled: filled(*a).withColumn("ids", L.F.reverse("ids")))
    assert {r["doc_id"]: r["decoded"] for r in L.token_digests(frame(spark, [(1, "the cat"), (2, "the")]), model).collect()} == {1: False, 2: True}


def test_merges_in_order_of_score(spark):
    model = M.model_bytes()
    pieces = L.load_pieces(model)
    assert L.merged_in_order(model) == ["▁▁"]
    table = {p: (i, s) for i, p, s, _ in pieces.rows if p is not None}
    rng = random.Random(3)
    words = sorted({"▁" * rng.choice([0, 1, 1, 1, 2, 15, 17]) + "".join(rng.choice("aeinrsthlod龘é") for _ in range(rng.randint(1, 30))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r["word"]: r["ids"] for r in L.encode_words(df, spark, model).collect()} == {w: L.merge_word(w, table, pieces) for w in words}


def test_place_marks_are_sparks(spark):
    rows = [(0, 5), (1, -7), (70_000, 1 << 62), (3, 0)]
    want = [r[0] for r in spark.createDataFrame(rows, "p int, h long").select(L.F.xxhash64("p", "h").bitwiseAND(L.F.lit(L.DIGEST))).collect()]
    p, h = (L.np.array(x, L.np.int64) for x in zip(*rows))
    assert L.place_marks(p, h).tolist() == want
