"""Hand-traced vectors and properties of the kernel."""

import math
import pickle
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.functions import codec
from glyphloom.operators.kernel import CLOSE, OPEN, BoundarySequencer, IntSequencer, LZGate, MarkovStats, MDLGate, MergeSequencer, SeenCache, build, lz_cuts, mdl_cuts, stack_tokens, strip_marks
from glyphloom.operators.sequence import _snapshot

TEXTS = st.text(alphabet=st.sampled_from("ab cé世😀\x00"), max_size=60)


def drive(seq, text):
    out = [t for c in text for t in seq.push(ord(c))]
    return out, seq.flush()


def words(ts):
    return ["".join(map(chr, t)) for t in ts]


def test_keys():
    for ints, key in (([97], 2725714748), ([97, 98], 2892778662), ([98], 2725714749), ([0], 2725714651), ([-1], 2725714650), ([-2], 2725714649)):
        assert codec.key_of(ints) == key


def test_lz_ababab():
    done, flush = drive(build(), "ababab")
    assert words(done) == ["", "a", "b", "ab"] and words(flush) == ["ab"]


@pytest.mark.parametrize("text,done,flush", [("", [], [""]), ("a", [""], ["a"]), ("aa", ["", "a"], ["a"]), ("aaaaaaaa", ["", "a", "aa", "aaa"], ["aa"])])
def test_short_streams(text, done, flush):
    got = drive(build(), text)
    assert (words(got[0]), words(got[1])) == (done, flush)


def test_ids():
    assert codec.encode_id([]) == 0 and codec.encode_id([97, 98]) == 205520995
    assert codec.encode_id([97, 98, 97, 98]) == 903890895018578149475
    assert codec.decode_id(903890895018578149475) == [97, 98, 97, 98]
    with pytest.raises(ValueError):
        codec.decode_id(-1)
    with pytest.raises(ValueError):
        codec.encode_id([-1])
    with pytest.raises(ValueError):
        codec.pop_id(0)
    assert codec.append_id(0, 97, 98) == codec.encode_id([97, 98])
    assert codec.pop_id(codec.encode_id([1, 2, 3, 4, 5]), 4) == (codec.encode_id([1]), [2, 3, 4, 5])
    assert codec.pop_id(codec.encode_id([1, 2]), 4) == (0, [1, 2])


@given(st.lists(st.integers(0, 0x10FFFF), max_size=12))
def test_id_round_trip(cps):
    assert codec.decode_id(codec.encode_id(cps)) == cps


def test_pack():
    assert codec.pack([]) == 0 and codec.pack([0]) == 1 and codec.pack([97]) == 24833
    assert codec.pack([0x4E16]) == 5633 and codec.unpack(5633) == [22]
    with pytest.raises(ValueError):
        codec.pack([1] * 6)


@given(st.lists(st.integers(0, 255), max_size=5))
def test_pack_round_trip(b):
    assert codec.unpack(codec.pack(b)) == b


def test_default_stack_drops_input_and_makes_nul():
    done, flush = drive(build("merge"), "aa")
    assert done == [[], [0]] and flush == [[0], [97]]


def test_reward_merge():
    b = BoundarySequencer(IntSequencer())
    for t in ([-1, 5], [6], [-2], [7], [8, -2], [9]):
        b._reward(t)
    assert list(b.queue) == [[-1, 5, 6, -2], [7, 8, -2], [9]]
    assert [strip_marks(t) for t in b.queue] == [[5, 6], [7, 8], [9]]
    assert (OPEN, CLOSE) == (-1, -2)


def test_expand():
    m = MergeSequencer(IntSequencer())
    assert m._expand([24833]) == [97] and m._expand([1]) == [1] and m._expand([256]) == [256]
    assert m._expand([0x4E16]) == [0] * 21 + [78]


def test_packed_keys_lose_the_first_byte():
    key = lambda s: codec.key_of([codec.pack([ord(c) for c in s])])
    assert key("abcd") == key("xbcd") and key("abc") != key("xbc")


def test_merge_keeps_the_last_emission_of_a_long_token():
    m = MergeSequencer(IntSequencer(), [LZGate()])
    m.inner.push = lambda x: [[1, 2, 3, 4, 5]]
    assert m.push(0) == [[4]]
    m2 = MergeSequencer(IntSequencer(), [LZGate()], compat="lossless")
    m2.inner.push = lambda x: [[1, 2, 3, 4, 5]]
    assert m2.push(0) == [[1], [2], [3], [4]]


def test_cache_evicts_the_least_recent():
    g = LZGate(cache=2)
    assert [g.evaluate(k) for k in (1, 2, 1, 3, 2)] == [False, False, True, False, False]
    assert g.snapshot()["pass_rate"] == 0.2 and g.snapshot()["custom_metrics"]["cacheUtilization"] == 1.0
    g.reset()
    assert g.ingested == 0 and not g.cache.counts


def test_mdl_first_event():
    g = MDLGate()
    assert not g.evaluate(1, 2)
    assert g.mean == pytest.approx(0.98 * 0.2 + 0.02 * (1 - 1e-12), abs=1e-15)


def test_mdl_fixed():
    g = MDLGate(z_mode="fixed", z_fixed=256)
    assert not g.evaluate(1, 2)
    assert g.mean == pytest.approx(0.196078125, abs=1e-15)
    assert g.threshold(256) == pytest.approx(256**-0.8) and g.threshold(0) == 0.0 and g.threshold(10**6) == 2048**-0.8
    stats = g.stats
    g.reset()
    assert g.stats is stats and stats.parent_count(2) == 1 and g.ingested == 0


def test_markov_masks_to_twenty_bits():
    s = MarkovStats()
    s.push(5, 9)
    s.push(5 + (1 << 20), 9)
    assert s.parent_count(5) == 2 and s.edge_count(5, 9) == 2 and s.degree(5) == 1


def test_no_gates_pass_everything_to_the_flush():
    done, flush = drive(build(gate="none"), "hello")
    assert done == [] and words(flush) == ["hello"]


def test_first_failing_gate_ends_the_evaluation():
    seen = []

    class Probe(LZGate):
        def evaluate(self, current, previous=0):
            seen.append(current)
            return True

    s = IntSequencer([LZGate(), Probe()])
    drive(s, "aaa")
    assert len(seen) == 1  # only the one key that the first gate passed


def test_reset():
    s = build()
    drive(s, "abab")
    s.reset()
    assert s.candidate == [] and s.ints_in == 0 and s.key != codec.SEED
    t = build(compat="lossless")
    drive(t, "abab")
    t.reset()
    assert t.key == codec.SEED


@given(TEXTS, st.sampled_from(["int", "boundary", "merge"]), st.sampled_from(["lz", "mdl"]))
@settings(max_examples=150, deadline=None)
def test_lossless_tokens_are_the_input(text, stack, gate):
    done, flush = drive(build(stack, gate, "lossless"), text)
    assert "".join(words(done + flush)) == text
    assert all(done + flush)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_fast_cuts_are_the_kernel(text):
    done, _ = drive(build(), text)
    cuts = lz_cuts([ord(c) for c in text])
    assert [text[i:j] for i, j in zip([0, *cuts], cuts, strict=False)] == words(done)


@given(TEXTS, st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_small_caches(text, capacity):
    done, _ = drive(build(capacity=capacity), text)
    cuts = lz_cuts([ord(c) for c in text], capacity)
    assert [text[i:j] for i, j in zip([0, *cuts], cuts, strict=False)] == words(done)


@given(TEXTS, st.integers(0, 60), st.sampled_from(["int", "boundary", "merge"]), st.sampled_from(["reference", "lossless"]))
@settings(max_examples=80, deadline=None)
def test_streams_can_be_put_down(text, at, stack, compat):
    whole = drive(build(stack, compat=compat), text)
    s = build(stack, compat=compat)
    done = [t for c in text[:at] for t in s.push(ord(c))]
    s = pickle.loads(pickle.dumps(s))
    done += [t for c in text[at:] for t in s.push(ord(c))]
    assert (done, s.flush()) == whole


def test_shared_and_own_caches_differ():
    assert isinstance(build("merge").gates[0].cache, SeenCache)
    m = build("merge")
    assert m.gates[0].cache is m.inner.gates[0].cache is m.inner.inner.gates[0].cache
    m = build("merge", shared=False)
    assert m.gates[0].cache is not m.inner.gates[0].cache


def test_snapshot_lists_outer_first():
    m = build("merge")
    drive(m, "abcabcabc")
    snap = m.snapshot()
    assert [s["name"] for s in snap] == ["merge", "boundary", "int"]
    assert snap[2]["ints_in"] >= 1 and math.isclose(snap[2]["ints_per_emit"], snap[2]["ints_in"] / snap[2]["sequences_emitted"])


def whole(text, stack, compat, capacity):
    flat, ends, n, counts, keys = stack_tokens([ord(c) for c in text], stack, compat, capacity)
    out = [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]
    return (out[:n], out[n:]), counts, keys


@given(TEXTS, st.sampled_from(["boundary", "merge"]), st.sampled_from(["reference", "lossless"]), st.sampled_from([1, 2, 5, 30, 70_000]))
@settings(max_examples=600, deadline=None)
def test_stacks_in_one_loop_are_the_kernel(text, stack, compat, capacity):
    seq = build(stack, compat=compat, capacity=capacity)
    done = [t for c in text for t in seq.push(ord(c))]
    snap, keys = seq.snapshot(), len(seq.gates[0].cache.counts)
    got = whole(text, stack, compat, capacity)
    assert got[0] == (done, seq.flush())
    assert got[1] == [(x["ints_in"], x["sequences_emitted"]) for x in snap]
    short = stack_tokens([ord(c) for c in text], stack, compat, capacity, flush=False)
    assert short[4] == keys and _snapshot(short, stack, capacity) == snap


@pytest.mark.parametrize("compat", ["reference", "lossless"])
@pytest.mark.parametrize("stack", ["boundary", "merge"])
def test_long_stacks_in_one_loop(stack, compat):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéß世😀", k=rng.randint(1, 9))) for _ in range(80)]
    text = " ".join(rng.choices(words, k=4000))
    for capacity in (500, 3000, 70_000):
        assert whole(text, stack, compat, capacity)[0] == drive(build(stack, compat=compat, capacity=capacity), text)


def test_mdl_cuts_are_the_kernel():
    rng = random.Random(8)
    for text in ["", "a", "aaaa" * 300, "".join(rng.choices("abc ", k=5000)), " ".join(rng.choices(["the", "cat", "世界", "sat"], k=2000))]:
        done, _ = drive(build(gate="mdl"), text)
        cuts = mdl_cuts([ord(c) for c in text])
        assert [text[i:j] for i, j in zip([0, *cuts], cuts, strict=False)] == words(done)


@pytest.mark.parametrize("n", [1, 50, 200])
def test_cuts_that_pass_the_cache(n):
    text = "".join(random.Random(n).choices("abcdef", k=900))
    done, _ = drive(build(capacity=n), text)
    cuts = lz_cuts([ord(c) for c in text], n)
    assert [text[i:j] for i, j in zip([0, *cuts], cuts, strict=False)] == words(done)


def best(f):
    """The least CPU seconds of three runs."""
    times = []
    for _ in range(3):
        t = time.process_time()
        f()
        times.append(time.process_time() - t)
    return min(times)


LONG = " ".join(random.Random(3).choices(["online", "token", "graph", "of", "weighted", "edges"], k=6000))


def test_merge_stack_takes_less_than_half_the_time():
    assert best(lambda: stack_tokens([ord(c) for c in LONG], "merge")) < 0.5 * best(lambda: drive(build("merge"), LONG))


def test_lossless_merge_stack_takes_less_than_half_the_time():
    assert best(lambda: stack_tokens([ord(c) for c in LONG], "merge", "lossless")) < 0.5 * best(lambda: drive(build("merge", compat="lossless"), LONG))


def test_snapshots_take_less_than_half_the_time():
    def steps():
        seq = build("merge")
        for c in LONG:
            seq.push(ord(c))
        return seq.snapshot()

    one = lambda: _snapshot(stack_tokens([ord(c) for c in LONG], "merge", flush=False), "merge", 70_000)
    assert one() == steps() and best(one) < 0.5 * best(steps)


def test_boundary_stack_takes_less_than_half_the_time():
    assert best(lambda: stack_tokens([ord(c) for c in LONG], "boundary")) < 0.5 * best(lambda: drive(build("boundary"), LONG))


def test_mdl_cuts_take_less_than_three_quarters_of_the_time():
    assert best(lambda: mdl_cuts([ord(c) for c in LONG])) < 0.75 * best(lambda: drive(build(gate="mdl"), LONG))
