"""Transcripts: window ownership, order checks, speakers by online clustering, labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEW_SPEAKER = 0.20
NEW_SPEAKER_EXPECTED = 0.45
RELIABLE = 0.58
MARGIN = 0.035
MAX_SPEAKERS = 16


def own_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of overlapping windows (rec_id, window, win_start, win_end, at_ms, text): each kept by one window.

    The border of two windows is the middle of their overlap, half open.
    """
    spans = tokens.select("rec_id", "window", "win_start", "win_end").distinct()
    w = W.partitionBy("rec_id").orderBy("win_start", "window")
    lo = F.coalesce((F.col("win_start") + F.lag("win_end").over(w)) / 2, F.col("win_start").cast("double"))
    hi = F.coalesce((F.col("win_end") + F.lead("win_start").over(w)) / 2, F.col("win_end").cast("double") + 1)
    own = spans.select("rec_id", "window", lo.alias("lo"), hi.alias("hi"))
    return tokens.join(own, ["rec_id", "window"]).where((F.col("at_ms") >= F.col("lo")) & (F.col("at_ms") < F.col("hi"))).drop("lo", "hi")


def out_of_order(segments: DataFrame) -> DataFrame:
    """Segments that start before the one before them, or end before they start."""
    w = W.partitionBy("rec_id").orderBy("seq")
    return segments.withColumn("_before", F.lag("start_ms").over(w)).where((F.col("start_ms") < F.col("_before")) | (F.col("end_ms") < F.col("start_ms"))).drop("_before")


def segment_confidence(tokens: DataFrame) -> DataFrame:
    """Mean of the finite token probabilities of each segment, clamped to [0, 1]."""
    p = F.when(~F.isnan("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return tokens.groupBy("rec_id", "seg").agg(F.avg(p).alias("confidence"))


def diarize(segments: DataFrame, expected: int | None = None) -> DataFrame:
    """Speakers of a recording's segments (rec_id, seq, embedding) by online cosine clustering.

    A segment joins the nearest centroid, or founds one if none is near; it
    moves a centroid only if the choice is reliable. A recording is taken in
    its order, one task each.
    """
    create = NEW_SPEAKER_EXPECTED if expected else NEW_SPEAKER
    most = min(expected or MAX_SPEAKERS, MAX_SPEAKERS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: list[np.ndarray] = []
        out = []
        for r in pdf.sort_values("seq").itertuples():
            v = np.asarray(r.embedding, dtype=float)
            v = v / max(np.linalg.norm(v), 1e-12)
            sims = np.array([v @ (c / max(np.linalg.norm(c), 1e-12)) for c in sums])
            best = int(sims.argmax()) if len(sims) else -1
            top = float(sims[best]) if len(sims) else -1.0
            second = float(np.partition(sims, -2)[-2]) if len(sims) > 1 else -1.0
            if not len(sims) or (top < create and len(sums) < most):
                sums.append(v.copy())
                best, top, sure = len(sums) - 1, 1.0, True
            else:
                sure = top >= RELIABLE and top - second >= MARGIN
                if sure:
                    sums[best] = sums[best] + v
            out.append((r.rec_id, r.seq, best + 1, top, sure))
        return pd.DataFrame(out, columns=["rec_id", "seq", "speaker", "similarity", "reliable"])

    return segments.groupBy("rec_id").applyInPandas(run, "rec_id long, seq int, speaker int, similarity double, reliable boolean")


def label_speakers(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Names for (rec_id, speaker): those of `labels` (rec_id, speaker, label), else "Speaker n"."""
    x = segments.join(labels, ["rec_id", "speaker"], "left")
    return x.withColumn("label", F.coalesce("label", F.concat(F.lit("Speaker "), F.col("speaker").cast("string"))))
