"""Context packets: exact sizes, budgets, order and excerpts."""

import json
import random

import pytest

from tesserak.operators import packets
from tesserak.operators.packets import Policy


def candidate(doc_id, content, rank=None, unit=None, mandatory=False, citations=(), trust="UNVERIFIED", freshness="FRESH", score=0.5, title="t"):
    return {"doc_id": doc_id, "unit": unit, "title": title, "content": content, "rank": rank, "score": score, "mandatory": mandatory, "trust": trust, "freshness": freshness, "citations": list(citations)}


def made(rnd):
    n = rnd.randint(0, 9)
    words = ["needle", "hay", "é", '"quoted"', "line\n", "long" * 9]
    return [candidate(rnd.randint(1, 5), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))), rnd.choice([None, *range(1, 12)]), rnd.choice([None, "u1", "u2"]), rnd.random() < 0.2, [f"c{rnd.randint(0, 3)}"] * rnd.randint(0, 1), rnd.choice(packets.AUTHORITY), rnd.choice(packets.FRESHNESS), round(rnd.random(), 3)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_packets_hold_their_budget_and_say_what_is_left(seed):
    rnd = random.Random(seed)
    found, policy = made(rnd), Policy(rnd.choice([120, 300, 500, 900, 4000]), rnd.randint(1, 3), rnd.random() < 0.3)
    conflicts = [{"id": "k", "documents": [1, 2, 9]}] if rnd.random() < 0.3 else []
    packet, draft = packets.packed(seed, "needle hay", found, conflicts, policy)
    for p in (packet, packets.compacted(draft, Policy(policy.tokens // 2))):
        sent = packets.wire(p)
        assert json.loads(sent)["budget"]["serialized_tokens"] == packets.tokens(sent)
        assert packets.fits(p) or not p["sections"]
        assert p["continuations"] == [] or p["continuations"][0]["sections"] > 0
    if not packets.fits(packet):
        return
    real = {(c["doc_id"], c["unit"]) for c in found if c["content"].strip()}
    shown = {(s["doc_id"], s["unit"]) for s in packet["sections"]}
    left = {(c["doc_id"], c["unit"]) for c in draft.omitted}
    assert shown | left == real and len(packet["sections"]) == len(shown)
    per = {}
    for s in packet["sections"]:
        per[s["doc_id"]] = per.get(s["doc_id"], 0) + 1
        assert not policy.evidence or s["citations"]
    assert max(per.values(), default=0) <= policy.sections
    if conflicts:
        assert any("unavailable" in g for g in packet["gaps"])
    if policy.tokens == 4000 and not policy.evidence and policy.sections == 3:
        assert packet["status"] != "DEGRADED"


def test_required_material_comes_first_and_documents_take_turns():
    found = [candidate(1, "a" * 40, 1, "u1"), candidate(1, "b" * 40, 2, "u2"), candidate(2, "c" * 40, 3), candidate(3, "d" * 40, 9, mandatory=True), candidate(4, "e" * 40, 8)]
    packet, _ = packets.packed(1, "q", found, [{"id": "x", "documents": [4]}], Policy(4000))
    assert [(s["doc_id"], s["unit"]) for s in packet["sections"]] == [(3, None), (4, None), (1, "u1"), (2, None), (1, "u2")]
    one, draft = packets.packed(1, "q", found, [], Policy(4000, sections=1))
    assert [s["doc_id"] for s in one["sections"]] == [3, 1, 2, 4] and [c["unit"] for c in draft.omitted] == ["u2"]


def test_the_longest_excerpt_that_fits_is_shown():
    rnd = random.Random(3)
    for _ in range(8):
        body = "x" * rnd.randint(0, 3000) + " Needle Here " + "y" * rnd.randint(0, 3000)
        found = [candidate(1, body, 1)]
        _, draft = packets.packed(1, "needle here", found, [], Policy(5000))
        policy = Policy(rnd.randint(220, 500))
        small = packets.compacted(draft, policy)
        if not small["sections"] or small["sections"][0]["content"] == body:
            continue
        shown = small["sections"][0]["content"]
        assert shown in body and "Needle Here" in shown and small["status"] == "SUPPORTED" and packets.fits(small)
        other = packets.Draft(1, "needle here", policy, primary=found[0])
        longer = [n for n in range(len(shown) + 1, len(body)) if other.taken(found[0], packets.excerpt(body, "needle here", n), "COMPACT", also_left=True) and (other.sections.pop(), other.omitted.pop())]
        assert not longer


def test_missing_and_weakened_support_is_said():
    found = [candidate(1, "z" * 4000, 1), candidate(2, "small needle", 2)]
    packet, draft = packets.packed(1, "needle", found, [], Policy(300))
    assert packet["status"] == "DEGRADED" and packets.PRIMARY_OMITTED in packet["gaps"] and [s["doc_id"] for s in packet["sections"]] == [2]
    none, _ = packets.packed(1, "needle", [], [], Policy(300))
    assert none["status"] == "INSUFFICIENT_KNOWLEDGE" and none["gaps"] == [packets.NOTHING]
    tiny, _ = packets.packed(1, "needle", found, [], Policy(5))
    assert not packets.fits(tiny) and not tiny["sections"]


def test_packets_run_over_tables(spark):
    schema = "query_id long, query string, candidates array<struct<doc_id: long, unit: string, title: string, content: string, rank: long, score: double, mandatory: boolean, trust: string, freshness: string, citations: array<string>>>, conflicts array<struct<id: string, documents: array<long>>>"
    rows = [(1, "needle", [tuple(candidate(1, "a needle", 1).values())], None), (2, None, None, None), (3, "q", [(7, None, None, None, None, None, None, None, None, None)], [])]
    got = {(r.query_id, r.mode): r for r in packets.pack_context(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 6 and got[1, "FULL"].status == "SUPPORTED" and got[2, "COMPACT"].sections == 0 and got[3, "FULL"].sections == 0
