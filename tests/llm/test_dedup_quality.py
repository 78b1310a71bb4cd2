from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from groundtally.llm import quality_rules as q
from groundtally.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm.conftest import messy_texts


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def least(i):
    return float("-inf") if i is None else i


def test_exact_dedup_equals_grouping(messy):
    groups = defaultdict(list)
    for i, t in messy_texts():
        groups[small(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep, sha, once = max(ids, key=least), hashlib.sha256(t.encode()).hexdigest(), True
        for i in sorted(ids, key=least, reverse=True):
            want[i, keep, len(ids), i == keep and once, sha] += 1
            once &= i != keep
    got = Counter(tuple(r) for r in exact_dedup(messy, digest_all=True).select("id", "keep_id", "group_size", "kept", "sha").collect())
    assert got == want
    assert Counter(tuple(r)[:4] for r in exact_dedup(messy, prefix_chars=1).select("id", "keep_id", "group_size", "kept").collect()) == Counter(k[:4] for k in want.elements())


def test_drop_copies_keeps_one_row_of_each_text(messy, make_docs):
    left = drop_copies(messy)
    assert left.columns == messy.columns
    texts = [small(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({small(t) for _, t in messy_texts()})
    assert drop_copies(make_docs([])).count() == 0 and exact_dedup(make_docs([])).count() == 0


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(words) < 2000 else None
    lines, dup = text.split("\n"), 0
    for k, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, covered and len(covered) or 0


def test_ledger_equals_definitions(make_docs):
    texts = ["a b c a b c d", "a b c a b c", "a a a a", "x\x1fy z w\x85v", "é é\nq\n\nq\n q\nq", "#*$ % & |<>", None, "", "w " * 60, "k\x0bl\x0cm\rn", "a b c d a b c d e b c d"]
    got = {r.id: r for r in q.ledger(make_docs(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == naive(t), t
        assert bool(r.failures & q.mask_of("few_words")) == (r.n_words < 50)


def test_policies_ablations_and_filter_agree(messy, make_docs):
    entries = q.ledger(messy).cache()
    rows = entries.collect()
    assert len(rows) == len(messy_texts())
    for r in q.ablations(entries).collect():
        mask, bit = q.POLICIES[r.version].mask, q.mask_of(r.rule)
        assert (r.failed, r.rejected, r.rejected_without) == tuple(sum(bool(x.failures & m) for x in rows) for m in (bit, mask, mask & ~bit))
    kept = q.keep_passing(messy)
    assert kept.columns == messy.columns and kept.count() == sum(not x.failures & q.CURRENT.mask for x in rows)
    assert q.ledger(make_docs([])).count() == 0 and q.keep_passing(make_docs([])).count() == 0
