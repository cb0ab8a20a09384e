"""Losses of logits tables as array expressions: one row in, one number out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A


def log_softmax(x: Column) -> Column:
    whole = A.logsumexp(x)
    return F.transform(x, lambda v: v - whole)


def ldam_loss(logits: Column, target: Column, margins: Column, scale: float = 30.0, smoothing: float = 0.0) -> Column:
    """Cross-entropy of scale * (logits less the target's margin at the target); targets count from 0.

    With smoothing the target distribution keeps 1 - smoothing plus an even share.
    """
    shifted = F.transform(logits, lambda v, i: (v - F.when(i == target, F.get(margins, target)).otherwise(0.0)) * scale)
    logp = log_softmax(shifted)
    picked = F.get(logp, target)
    return -(1 - smoothing) * picked - smoothing * A.total(logp) / F.size(logp)


def cross_entropy(logits: Column, target: Column) -> Column:
    return -F.get(log_softmax(logits), target)


def distillation_loss(student: Column, teacher: Column, target: Column, temperature: float = 4.0, alpha: float = 0.7) -> Column:
    """alpha * T^2 * KL(teacher || student at T) + (1 - alpha) * cross-entropy."""
    s, t = log_softmax(A.scaled(student, 1 / temperature)), log_softmax(A.scaled(teacher, 1 / temperature))
    kl = A.total(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)))
    return alpha * temperature**2 * kl + (1 - alpha) * cross_entropy(student, target)
