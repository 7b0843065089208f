"""Clusters of vectors as they come: nearest centres, a backlog that founds new clusters, counts that ask for new labels."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The least cosine with a centre, new members after which a label is due, vectors of the backlog that start a search, and fewest of a cluster.
LEAST = 0.55
RELABEL = 5
BACKLOG = 5
FEWEST = 3
#: Bounds of a group's state: vectors that wait, and clusters.
WAITING, CLUSTERS = 256, 1024
#: Members of a cluster that its label is made of.
SHOWN = 3

OUT = T.StructType([T.StructField("grp", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("members", T.LongType()), T.StructField("relabels", T.IntegerType()), T.StructField("shown", T.ArrayType(T.LongType()))])
_CENTRE = "place int, centre array<double>, members long, since int, relabels int, shown array<long>"
_WAIT = "id long, unit array<double>"


def unit(vector: Any) -> np.ndarray | None:
    """The vector at length one, or None for one that is null, empty, zero or not finite."""
    if vector is None or not len(vector):
        return None
    x = np.asarray([np.nan if v is None else v for v in vector], dtype=float)
    length = np.linalg.norm(x)
    return x / length if np.isfinite(length) and length > 0 else None


class OnlineClusters(StatefulProcessor):
    """The state of one group: centres by cluster and the vectors that wait for one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centres = handle.getMapState("centres", "cluster long", _CENTRE)
        self.backlog = handle.getListState("backlog", _WAIT)

    def _load(self) -> None:
        held = sorted(((k[0], *v) for k, v in self.centres.iterator()), key=lambda c: c[1])
        self.names = [c[0] for c in held]
        self.matrix = np.array([c[2] for c in held], dtype=float)
        self.facts = [[c[3], c[4], c[5], list(c[6])] for c in held]
        self.waiting = [(w[0], np.asarray(w[1], dtype=float)) for w in self.backlog.get()]
        self.size = self.matrix.shape[1] if held else len(self.waiting[0][1]) if self.waiting else None
        self.touched, self.placed = set(), {}

    def _take(self, vec_id: int, x: np.ndarray | None) -> None:
        if x is None or len(x) != (self.size or len(x)):
            self.placed[vec_id] = None
            return
        self.size = len(x)
        cosines = self.matrix @ x if self.names else np.zeros(0)
        if len(cosines) and cosines.max() >= LEAST:
            at = int(cosines.argmax())
            self._join(at, vec_id, x)
            return
        self.placed[vec_id] = None
        self.waiting.append((vec_id, x))
        if len(self.waiting) >= BACKLOG and len(self.names) < CLUSTERS:
            self._found()
        del self.waiting[:-WAITING]

    def _join(self, at: int, vec_id: int, x: np.ndarray) -> None:
        facts = self.facts[at]
        moved = self.matrix[at] * facts[0] + x
        self.matrix[at] = moved / np.linalg.norm(moved)
        facts[0] += 1
        facts[1] += 1
        if facts[1] >= RELABEL:
            facts[1], facts[2] = 0, facts[2] + 1
        self.placed[vec_id] = self.names[at]
        self.touched.add(at)

    def _found(self) -> None:
        """A cluster of the waiting vector that the most others are near to, with these, if they are enough."""
        units = np.array([x for _, x in self.waiting])
        near = units @ units.T >= LEAST
        np.fill_diagonal(near, True)
        seed = int(near.sum(axis=1).argmax())
        if near[seed].sum() < FEWEST:
            return
        centre = units[near[seed]].sum(axis=0)
        members = [vec_id for (vec_id, _), inside in zip(self.waiting, near[seed], strict=True) if inside]
        name = self.waiting[seed][0]
        row = (centre / np.linalg.norm(centre))[None, :]
        self.matrix = np.concatenate([self.matrix, row]) if self.names else row
        self.names.append(name)
        self.facts.append([len(members), 0, 0, members[:SHOWN]])
        self.touched.add(len(self.names) - 1)
        self.placed |= dict.fromkeys(members, name)
        self.waiting = [w for w, inside in zip(self.waiting, near[seed], strict=True) if not inside]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._load()
        group = int(key[0])
        batch = pd.concat(rows).dropna(subset=["vec_id"]).sort_values(["at", "vec_id"], na_position="last", kind="stable")
        for vec_id, vector in zip(batch["vec_id"], batch["embedding"], strict=True):
            self._take(int(vec_id), unit(vector))
        for at in self.touched:
            self.centres.updateValue((self.names[at],), (at, self.matrix[at].tolist(), *self.facts[at]))
        if self.waiting:
            self.backlog.put([(vec_id, x.tolist()) for vec_id, x in self.waiting])
        else:
            self.backlog.clear()
        out = [(group, "vector", vec_id, cluster, None, None, None) for vec_id, cluster in self.placed.items()]
        out += [(group, "cluster", self.names[at], self.names[at], self.facts[at][0], self.facts[at][2], self.facts[at][3]) for at in sorted(self.touched)]
        frame = pd.DataFrame(out, columns=OUT.names)
        yield frame.astype({"cluster": "Int64", "members": "Int64", "relabels": "Int32"})

    def close(self) -> None:
        return


def online_clusters(vectors: DataFrame) -> DataFrame:
    """``grp, kind, id, cluster, members, relabels, shown``: what a batch of a stream of ``grp, vec_id, at, embedding`` changes.

    Rows of kind ``vector`` tell the cluster of a vector (null: none), those of
    kind ``cluster`` a cluster's members and how often a new label was due: after
    each RELABEL members that joined; ``shown`` are its first members. A vector
    joins the centre nearest to it at a cosine of LEAST or more (ties: the older
    cluster), which moves as a running mean. Others wait; once BACKLOG vectors
    do, the one with the most others near it founds a cluster with them if they are FEWEST (ties: the one that
    came first), named by it, and its members get a new row. Vectors are taken
    by batch, ``at`` and ``vec_id``. Null, zero and non-finite vectors and those
    of another length than the group's first are in no cluster and do not wait;
    rows without group or vec_id are left out. A vector that comes again is taken again.

    A group's state holds CLUSTERS centres and the WAITING vectors that came
    last, so it does not grow with the stream: a vector that is pushed out of the backlog stays in
    no cluster here, and :func:`density.density_clusters` over the stored table
    is the exact way for it. A group's vectors are taken in order by one task,
    as each centre depends on all before. Needs the RocksDB state store.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker does not see files that were sent along
    return vectors.filter("grp is not null").groupBy("grp").transformWithStateInPandas(OnlineClusters(), OUT, "update", "none")
