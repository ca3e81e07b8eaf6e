"""Embedding near-dedup: an exact metric range join on the unit sphere.

Cosine >= c means a chord of at most eps = sqrt(2 - 2c). The vectors of a space (label and dimension) are partitioned by
pivots: a pivot is the centre of a dense place of a sample, with a radius at which few vectors lie. A vector lives in
the cell of the first pivot whose ball holds it, else in the rest. By the triangle inequality |d(x,p) - d(y,p)| <= d(x,y),
so only vectors within eps of a ball's border can have neighbours beyond it; these visit the cells there. Each cell then
joins its own vectors with its own and its visitors, alone: every vector's links are all found in its home cell.

Inside a cell, pairs are left out by a second set of pivots, far apart and made orthogonal: with a and b the coordinates
of x and y along them and r, s the lengths of what is left, the cosine is at most a.b + r*s. Only pairs whose bound
reaches c are multiplied in full. Equal vectors are one point that carries their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, salted, sized, stage, stream_groups
from finquarry.llm.components import connected_components

_POINT = "vec_id long, n long, label string, dim int, ball int, home boolean, u binary"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the unit vector (float64 bytes), null where the vector links with nothing."""
    for batch in batches:
        out = []
        for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.array(v, dtype=np.float64) if v is not None and label is not None and None not in v else np.zeros(0)
            scale = np.abs(x).max(initial=0.0)
            ok = 0 < scale < np.inf  # a NaN fails too
            y = x / scale if ok else x
            out.append((y / np.sqrt(y @ y)).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "u"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


def ball_pivots(x: np.ndarray, eps: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of dense places of a sample: (pivots, radii), densest first.

    A centre is the vector with most neighbours within eps, two at least; its radius is that between eps and 1.2 with
    fewest vectors within eps of the border. Places whose border would be as crowded as the ball are left out.
    """
    d, left, at, radii = _chord(x, x), np.ones(len(x), dtype=bool), [], []
    grid = np.linspace(eps, 1.2, 24)
    while len(at) < most and left.any():
        near = ((d <= eps) & left).sum(axis=1) * left
        i = int(np.argmax(near))
        if near[i] < 3:
            break
        own = d[i][left]
        crowd = [(np.abs(own - r) <= eps).sum() for r in grid]
        r = float(grid[int(np.argmin(crowd))])
        inside = (d[i] <= r) & left
        if min(crowd) < inside.sum():
            at.append(i)
            radii.append(r)
            left &= ~inside
        else:
            left &= d[i] > eps
    return x[at], np.array(radii)


def places(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and the cells it must be in (rows x cells). Cell k is ball k; the last cell is the rest."""
    d = _chord(x, pivots)
    inside = d <= radii
    own = np.concatenate([inside, np.ones((len(x), 1), bool)], axis=1).argmax(axis=1)
    near, beyond = d <= radii + eps + 1e-9, d > radii - eps - 1e-9
    clear = np.concatenate([np.ones((len(x), 1), bool), np.logical_and.accumulate(beyond, axis=1)], axis=1)  # may lie outside all balls before
    return own, clear & np.concatenate([near, np.ones((len(x), 1), bool)], axis=1)


def orthogonal_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal columns that span vectors of x far from each other."""
    at, near = [0], _chord(x, x[:1])[:, 0]
    while len(at) < min(most, x.shape[1] - 1, len(x)) and near.max() > 1e-6:
        at.append(int(np.argmax(near)))
        near = np.minimum(near, _chord(x, x[at[-1:]])[:, 0])
    return np.linalg.qr(x[at].T)[0]


def bounded(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Coordinates along the columns of q and the length of the rest: products of such rows bound cosines from above."""
    a = x @ q
    return np.concatenate([a, np.sqrt(np.maximum(0, 1 - (a * a).sum(axis=1)))[:, None]], axis=1).astype(np.float32)


def _choose(eps: float, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, r = ball_pivots(_matrix(pdf.sort_values("vec_id")["u"]), eps, most)
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "pivots": [p.tobytes()], "radii": [r.tobytes()]})

    return run


def _deal(eps: float):
    """Points with their space's pivots to the cell that they belong to and those that they visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, g in pdf.groupby(["label", "dim"], sort=False):
                x = _matrix(g["u"])
                p, r = (g[c].iloc[0] or b"" for c in ("pivots", "radii"))
                own, need = places(x, np.frombuffer(p, dtype=np.float64).reshape(-1, x.shape[1]), np.frombuffer(r, dtype=np.float64), eps)
                i, cell = np.nonzero(need)
                yield g.iloc[i][["vec_id", "n", "label", "dim", "u"]].assign(ball=cell.astype(np.int32), home=own[i] == cell)[[f.split()[0] for f in _POINT.split(", ")]]

    return run


def _join(cosine: float, directions: int):
    """Links of a block's home vectors with a block of members: (vec_id, links, other, pairs, compared); other: a tie in
    a spanning forest of the links seen here; pairs: how many there are, compared: how many were multiplied in full."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in stream_groups(frames, ["label", "dim", "ball", "i", "j"]):
            h, m = g[g["asks"]], g[~g["asks"]]
            if not len(h) or not len(m):
                continue
            x, y = _matrix(h["u"]), _matrix(m["u"])
            hid, mid, n = h["vec_id"].to_numpy(), m["vec_id"].to_numpy(), m["n"].to_numpy()
            q = orthogonal_pivots(y[:2048], directions)
            bx, by = bounded(x, q), bounded(y, q).T
            ids = np.unique(np.concatenate([hid, mid]))
            hat, mat = np.searchsorted(ids, hid), np.searchsorted(ids, mid)
            root, links, compared = np.arange(len(ids)), np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
            for at in range(0, len(h), 256):
                part = slice(at, at + 256)
                may = bx[part] @ by >= cosine - 1e-5  # single precision: well above its error
                compared[part] = may.sum(axis=1)
                if may.mean() > 0.2:
                    a, b = np.nonzero(may & (x[part] @ y.T >= cosine))
                else:
                    a, b = np.nonzero(may)
                    close = np.einsum("ij,ij->i", x[at + a], y[b]) >= cosine
                    a, b = a[close], b[close]
                other = hid[at + a] != mid[b]
                a, b = a[other], b[other]
                links[part] = np.bincount(a, weights=n[b], minlength=len(links[part])).astype(np.int64)
                a, b = hat[at + a], mat[b]
                while len(a):  # hook the larger root to the smaller until nothing changes
                    ra, rb = root[a], root[b]
                    if (ra == rb).all():
                        break
                    low = np.minimum(ra, rb)
                    np.minimum.at(root, ra, low)
                    np.minimum.at(root, rb, low)
                    while (root != root[root]).any():
                        root = root[root]
            yield pd.DataFrame({"vec_id": hid, "links": links, "other": hid, "pairs": np.int64(len(m)), "compared": compared})
            tied = np.flatnonzero(root != np.arange(len(ids)))
            yield pd.DataFrame({"vec_id": ids[tied], "links": 0, "other": ids[root[tied]], "pairs": 0, "compared": 0})

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.93, block_rows: int = 4096, most_pivots: int = 32, sample_rows: int = 1024, directions: int = 24, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", figures: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; only vectors of one label and dimension are compared.

    n_links: other rows at cosine >= `cosine` (doubles); component_id: the smallest vec_id reached by links; kept:
    it is the row's own. Null labels, null or zero vectors and vectors with null or non-finite components have no
    link. Rows with equal ids are one node; a row with a null id has no link and is kept. Empty table: no row.
    Pivots come from about sample_rows points of each space, chosen by hash. Cells beyond block_rows are joined block
    by block. `figures`, if given, receives the numbers of points, their places in cells, pairs and full products.
    """
    eps = math.sqrt(2 - 2 * cosine)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = stage(src.mapInArrow(_unit, "vec_id long, label string, u binary").withColumns({"h1": F.xxhash64("u", "label"), "h2": F.xxhash64(F.lit(7), "label", "u")}), "emb-rows")
    valid = rows.filter("u is not null and vec_id is not null")
    dim = F.octet_length(F.first("u")).cast("int")
    points = stage(valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("u").alias("u"), F.first("label").alias("label"), dim.alias("dim")), "emb-points")

    space = ["label", "dim"]
    spaces = stage(points.groupBy(*space).agg(F.count("*").alias("rows")), "emb-spaces")
    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = points.join(sized(spaces, 128), space).filter(draw < F.lit(float(sample_rows)) / F.col("rows")).select(*space, "vec_id", "u")
    pivots = stage(drawn.groupBy(*space).applyInPandas(_choose(eps, most_pivots), "label string, dim int, pivots binary, radii binary"), "emb-pivots")
    cells = stage(points.join(sized(pivots, most_pivots * 8192), space, "left").mapInPandas(_deal(eps), _POINT), "emb-cells")

    cell = ["label", "dim", "ball"]
    sizes = cells.groupBy(*cell).agg(F.count("*").alias("rows"), F.max("home").alias("any")).filter("any and rows > 1")
    blocks = stage(sizes.select(*cell, F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")), "emb-blocks")
    dealt = cells.join(sized(blocks, 128), cell).withColumns({"block": F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).cast("int"), "k": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    asks = dealt.filter("home").select(*cell, F.col("block").alias("i"), F.col("k").alias("j"), F.lit(True).alias("asks"), "vec_id", "n", "u")
    told = dealt.select(*cell, F.col("k").alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "vec_id", "n", "u")
    grid = asks.unionByName(told).repartition(*cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
    found = stage(grid.mapInPandas(_join(cosine, directions), "vec_id long, links long, other long, pairs long, compared long"), "emb-found")
    if figures is not None:
        r = found.agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared")).first()
        figures |= {"points": points.count(), "places": cells.count(), "pairs": r.pairs or 0, "compared": r.compared or 0, "pairs_of_labels": spaces.agg(F.sum(F.col("rows") * F.col("rows"))).first()[0] or 0}
    drop_staged(spaces, pivots, cells, blocks)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    component = stage(connected_components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))), "emb-component").withColumnRenamed("node", "vec_id")

    own = points.select("h1", "h2", "vec_id", "n").join(links, "vec_id", "left").join(component, "vec_id", "left")
    own = own.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    # Rows of one much repeated vector are dealt to several tasks; rows without a vector or an id look nothing up.
    out = salted(valid.select("vec_id", "h1", "h2"), own, ["h1", "h2"], ["vec_id"], 64).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("u is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
