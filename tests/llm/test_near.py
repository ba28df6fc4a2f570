"""Proximity matches of copies in which a word was changed."""

from lynceus.llm import decontaminate
from tests.llm.data import frame


def test_changed_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    copy = lambda **new: " ".join(new.get(w, w) for w in item)
    rest = [(10 + i, " ".join(item[2:])) for i in range(5)]  # the words from gamma on are commoner than alpha and beta
    absent = [(1, copy(alpha="changed")), (2, "q w " + copy(alpha="changed")), (3, "iota x x x x x kappa x x x x x x theta"), (4, None)]
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.contamination(frame(spark, absent), bench).collect()}
    assert got == {1: (False, 1), 2: (False, 1), 3: (False, 0), 4: (False, 0)}  # alpha stands nowhere
    known = [(1, copy()), (2, copy(alpha="changed")), (3, copy(beta="changed")), (4, "alpha " * 3), (5, "beta alpha")]
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.contamination(frame(spark, known + rest), bench).collect()}
    assert [got[i] for i in range(1, 6)] == [(True, 1), (False, 1), (False, 1), (False, 0), (False, 0)]
