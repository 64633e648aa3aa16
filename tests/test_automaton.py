"""The dictionary automaton against a scan of every place and entry, and against the join."""

import random

from quarry.operators import annotate, automaton


def _scan(tokens, entries, most, once):
    out, free, seen = [], 0, set()
    for s in range(len(tokens)):
        here = sorted((-len(c.split(" ")), c, i, t) for i, c, t in entries if tokens[s : s + len(c.split(" "))] == c.split(" "))
        for n, c, i, t in here:
            if s >= free and len(out) < most and not (once and i in seen):
                out.append((i, c, t, s, s - n))
                seen.add(i)
                free = s - n
    return out


def test_against_scan_and_join(spark, monkeypatch):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd", "ee"]
    entries = [(f"E{k}", " ".join(rng.choices(words, k=rng.randint(1, 7))), "t") for k in range(60)]
    entries += [("E1", entries[7][1], "u"), ("E0", entries[0][1], "t"), ("E99", "zz", "t")]
    texts = [None, "", "zz", "..."] + [" ".join(rng.choices([*words, "AA", "other"], k=rng.choice([3, 40, 400]))) for _ in range(60)]
    corpus = spark.createDataFrame([(None if i == 9 else i, t) for i, t in enumerate(texts)] + [(3, texts[20])], "passage_id long, text string").repartition(3)
    entry = spark.createDataFrame(entries, "entity_id string, canonical string, entity_type string")
    for most, once in ((128, False), (128, True), (5, False)):
        monkeypatch.setattr(automaton, "TOKENS", 100)
        got = sorted(map(tuple, annotate.matches(corpus, entry, most=most, once=once).collect()), key=str)
        want = [(None if i == 9 else i, *m) for i, t in enumerate(texts) for m in _scan((t or "").lower().split(), entries, most, once) if t != "..."]
        want += [(3, *m) for m in _scan(texts[20].lower().split(), entries, most, once)]
        assert got == sorted(want, key=str)
    unique = corpus.where("passage_id <> 3")
    joined = sorted(map(tuple, annotate.greedy(annotate.spans(unique, entry), "passage_id").collect()))
    assert sorted(map(tuple, annotate.matches(unique, entry).collect())) == joined
    monkeypatch.setattr(automaton, "ENTRIES", 3)
    assert sorted(map(tuple, annotate.matches(unique, entry).collect())) == joined
    assert annotate.matches(corpus.limit(0), entry).count() == 0 and annotate.matches(corpus, entry.limit(0)).count() == 0
