"""What bounds a plan's size and a worker's memory."""

import random

from lodestack.llm import components as C
from lodestack.llm import piece_codec as P
from lodestack.llm.common import vocabulary


def test_rounds_have_small_plans(spark, monkeypatch):
    """A path and a hub: right components, and no written plan names its input more than three times."""
    leaves, staged = [], C.staged

    def counted(df, name):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return staged(df, name)

    monkeypatch.setattr(C, "staged", counted)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 500)] + [(5, 5), (None, 3)]
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in C.components(e, "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 500)]}
    assert max(leaves) <= 3


def test_units_are_indexed_in_bounded_batches(monkeypatch):
    """Many new units in one call: the index never holds many more characters than a batch has."""
    rng = random.Random(4)
    units = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 12))) for _ in range(90_000)]
    texts = [" ".join(units[i : i + 3_000]) for i in range(0, len(units), 3_000)]
    pieces, held, edges = P.PieceModel(vocabulary("piece_bpe_32k.model")), [], P.PieceModel.edges

    def counted(self, points):
        held.append(len(points))
        return edges(self, points)

    monkeypatch.setattr(P.PieceModel, "edges", counted)
    found = pieces.encode(texts)
    assert sum(held) > 600_000 and max(held) <= 250_000
    assert [pieces.decode(x) for x in found] == texts
