import hashlib
import random
from collections import Counter, defaultdict

from corpus import awkward, frame

from fintally.llm import exact_dedup as D


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        free = 1
        for i in ids:
            kept = bool(i == keep and free)
            free -= kept
            out[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_groups_match_brute_force(spark):
    rows = awkward()
    got = D.exact_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_tiny_tries_spill_and_give_the_same(spark):
    rng = random.Random(1)
    rows = [(n, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) * rng.choice([1, 40])) for n in range(600)]
    assert Counter(map(tuple, D.exact_groups(frame(spark, rows), trie_bytes=3000).collect())) == brute(rows)


def test_trie_spills_by_subtree():
    rng = random.Random(2)
    trie, want = D.Patricia(2000), Counter()
    for n in range(2000):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7)))
        trie.insert(s, n, 1, s)
        want[s] += 1
    assert trie.held < 10_000
    got = list(trie.ends())
    assert {e[2]: e[1] for e in got} == want and len(got) == len(want)


def test_drop_copies_keeps_one_row_of_each_text_with_all_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    got = D.drop_copies(docs)
    assert got.schema.names == docs.schema.names
    kept = got.collect()
    assert Counter((r["text"] or "") for r in kept) == Counter({t or "": 1 for _, t in rows})
    want = {(k[0], k[4]) for k in brute(rows) if k[3]}
    assert {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept} == want
    assert got.where("doc_id = 20 or text is null").count() == 0  # of the empty texts, the one of row 22 stays


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert D.exact_groups(empty).count() == 0 and D.drop_copies(empty).count() == 0
