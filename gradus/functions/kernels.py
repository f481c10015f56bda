"""Arithmetic over array columns and rewards, as Column expressions: nothing here leaves whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row: named in a lambda, it would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log probabilities, shifted by the maximum so that no exponential overflows."""
    def spread(scaled: Column, top: Column) -> Column:
        return F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top), lambda a: F.log(a) + top)

    def shifted(scaled: Column) -> Column:
        whole = bound(F.array_max(scaled), lambda top: spread(scaled, top))
        return bound(whole, lambda w: F.transform(scaled, lambda x: x - w))

    return bound(F.transform(logits, lambda x: x.cast("double") / F.lit(float(temperature))), shifted)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def probabilities(log_p: Column) -> Column:
    return F.transform(log_p, F.exp)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions over its maximum, in [0, 1]; terms of probability 0 are 0."""
    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * (F.log(a) - F.log(m))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return clamp(total(terms) / F.lit(2 * math.log(2)))


def entropy(p: Column) -> Column:
    """Entropy over that of the uniform distribution, in [0, 1]."""
    return clamp(-total(F.transform(p, _plogp)) / F.log(F.size(p).cast("double")))


def uncertainty(positive: Column, baseline: Column, teacher_entropy: Column, weight: float = 1.0, alpha: float = 0.5) -> tuple[Column, Column]:
    """(corrected gap, U): the gap is what the positive divergence has over the weighted baseline."""
    gap = clamp(positive - F.lit(weight) * baseline)
    return gap, F.lit(alpha) * gap + F.lit(1 - alpha) * teacher_entropy


def content_divergence(student: Column, teacher: Column, beta: float = 0.0, clip: float | None = None) -> Column:
    """Divergence of log distributions: forward KL at 0, reverse KL at 1, their mixture between.

    Entries are clipped from above before they are summed, so the sum may fall below 0.
    """

    def entry(s: Column, t: Column) -> Column:
        if beta == 0.0:
            out = F.exp(t) * (t - s)
        elif beta == 1.0:
            out = F.exp(s) * (s - t)
        else:
            mixed = F.log(F.lit(1 - beta) * F.exp(s) + F.lit(beta) * F.exp(t))
            out = F.lit(beta) * F.exp(t) * (t - mixed) + F.lit(1 - beta) * F.exp(s) * (s - mixed)
        return out if clip is None else F.least(out, F.lit(float(clip)))

    return total(F.zip_with(student, teacher, entry))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """Places of the k largest values, from 0; equal values in order of place."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("key"), i.alias("at"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["at"])


def gather(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.element_at(values, i + 1))


def even_places(n: Column, k: int) -> Column:
    """k places from 0 to n - 1, evenly apart and cut to whole numbers."""
    if k == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(k - 1)).cast("int"))


def ema(values: Column, start: Column, decay: float) -> Column:
    """A moving average folded over an array in order."""
    return F.aggregate(values, start, lambda m, x: F.lit(decay) * m + F.lit(1 - decay) * x)


def padded(values: Column, size: int, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, F.lit(size) - F.size(values)))


def prefix_mask(length: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i < length).cast("int"))


def l2(values: Column) -> Column:
    return F.sqrt(total(F.transform(values, lambda x: x.cast("double") * x.cast("double"))))


# Rewards.


def legacy_score(visual: Column, answer: Column, visual_confidence: Column, answer_confidence: Column) -> dict[str, Column]:
    """2V + Y, less a squared miss of V and, where V holds, of Y."""
    utility = 2 * visual + answer
    calibration = -F.pow(visual_confidence - visual, 2) - visual * F.pow(answer_confidence - answer, 2)
    return {"utility": utility.cast("double"), "calibration": calibration, "total": utility + calibration}


def proxy_score(answer: Column, certainty: Column, visual_confidence: Column, answer_confidence: Column, a: float = 1.0, rho_answer: float = 1.0, rho_visual: float = 1.0) -> dict[str, Column]:
    """aY - rho_a (r - Y)^2 - rho_v (v - S)^2."""
    if not a >= rho_answer > 0 or not rho_visual > 0:
        raise ValueError("weights must have a >= rho_answer > 0 and rho_visual > 0")
    utility, miss, apart = F.lit(a) * answer, -F.lit(rho_answer) * F.pow(answer_confidence - answer, 2), -F.lit(rho_visual) * F.pow(visual_confidence - certainty, 2)
    return {"utility": utility, "answer_calibration": miss, "visual_proxy_alignment": apart, "report": miss + apart, "total": utility + miss + apart}


def reward_block(answer: Column, certainty: Column, visual_confidence: Column, answer_confidence: Column, errors: Column, a: float = 1.0, rho_answer: float = 1.0, rho_visual: float = 1.0, penalty: float = 0.5) -> dict[str, Column]:
    """As proxy_score, but a missing report costs a squared miss of 1, and any format error one penalty."""
    utility = F.lit(a) * answer
    miss = -F.lit(rho_answer) * F.coalesce(F.pow(answer_confidence - answer, 2), F.lit(1.0))
    apart = -F.lit(rho_visual) * F.coalesce(F.pow(visual_confidence - certainty, 2), F.lit(1.0))
    report = miss + apart - F.when(errors, F.lit(penalty)).otherwise(F.lit(0.0))
    return {"utility": utility, "report": report, "content": utility + report}


def empty_certainty() -> Column:
    """What an example without usable vision tokens has: no certainty, no means, fallback."""
    parts = [F.lit(None).cast("double").alias(n) for n in ("raw_js", "baseline_js", "corrected_gap", "teacher_entropy", "uncertainty")]
    return F.struct(F.lit(0.0).alias("certainty"), *parts, F.lit(0).cast("long").alias("vision_tokens"), F.lit(True).alias("fallback"))


def with_fallback(examples: DataFrame, certainty: DataFrame, key: str) -> DataFrame:
    """One row for each example: its certainty, or ``empty_certainty`` where it has no tokens or none that count.

    certainty: (key, certainty, raw_js, baseline_js, corrected_gap, teacher_entropy, uncertainty, vision_tokens, fallback).
    """
    names = ["certainty", "raw_js", "baseline_js", "corrected_gap", "teacher_entropy", "uncertainty", "vision_tokens", "fallback"]
    found = certainty.where("vision_tokens > 0 AND NOT fallback").select(key, F.struct(*names).alias("_found"))
    return examples.select(key).join(found, key, "left").select(key, F.coalesce("_found", empty_certainty()).alias("_all")).select(key, "_all.*")


#: Rewards of the content and the report of a completion that breaks the earlier format.
MALFORMED_CONTENT, MALFORMED_REPORT = -2.0, -3.0


def unlabelled_block(answer: Column, certainty: Column, visual_confidence: Column, answer_confidence: Column, errors: Column, **weights: float) -> dict[str, Column]:
    """The earlier form of ``reward_block``: an answer whose label is null earns nothing, and its report costs a miss of 1."""
    known = F.coalesce(answer, F.lit(0))
    return reward_block(known, certainty, visual_confidence, F.when(answer.isNotNull(), answer_confidence), errors, **weights)


def attempt_rewards(parsed: Column, calibration: Column, total: Column) -> dict[str, Column]:
    """Rewards of content and report of attempts in the earlier format; malformed ones get the two constants."""
    return {"content": F.when(parsed, total).otherwise(F.lit(MALFORMED_CONTENT)), "report": F.when(parsed, calibration).otherwise(F.lit(MALFORMED_REPORT))}


def rollout_errors(errors: Column, fallback: Column, answered: Column, letters: Column, canonical: Column) -> Column:
    """Format errors with those of a fallback and, where the accepted answers are letters, of an answer that isn't one."""
    return F.array_compact(F.concat(errors, F.array(F.when(fallback, "vision_proxy_fallback"), F.when(answered & letters & ~canonical, "noncanonical_option_answer"))))


def log_ratio(student: Column, teacher: Column) -> Column:
    """Sum of log-probability differences of sampled tokens; null unless the arrays are as long and all are at most 0."""
    fair = (F.size(student) == F.size(teacher)) & F.forall(student, lambda x: x <= 0) & F.forall(teacher, lambda x: x <= 0)
    return F.when(fair, total(F.zip_with(student, teacher, lambda s, t: s - t)))


def sampled_weights(reward: Column, calibration: Column, ratio: Column, beta: float = 0.0, content_baseline: float = 0.0, report_baseline: float = 0.0) -> tuple[Column, Column]:
    return reward - F.lit(beta) * ratio - F.lit(content_baseline), calibration - F.lit(report_baseline)


def _masked(values: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])


def joint_loss(log_p: Column, content: Column, report: Column, divergence: Column, content_reward: Column, report_reward: Column, policy_weight: float, divergence_weight: float) -> dict[str, Column]:
    """A rollout's -R_c sum(content log p) - R_r sum(report log p), and the mean divergence of its content tokens.

    log_p and the masks of 0 and 1 are aligned with the sampled tokens; divergence has one entry a content token. The
    policy term is not divided by the tokens. Where there is no content the divergence is 0, and a mean of no tokens null.
    All are null where the arrays don't align.
    """
    c, r = _masked(log_p, content), _masked(log_p, report)
    policy = -content_reward * total(c) - report_reward * total(r)
    apart = F.when(F.size(c) > 0, total(divergence) / F.size(c)).otherwise(F.lit(0.0)) if divergence_weight > 0 else F.lit(0.0)
    aligned = (F.size(log_p) == F.size(content)) & (F.size(log_p) == F.size(report))
    if divergence_weight > 0:
        aligned = aligned & ((F.size(c) == 0) | (F.size(divergence) == F.size(c)))
    out = {
        "loss": F.lit(float(policy_weight)) * policy + F.lit(float(divergence_weight)) * apart, "policy_loss": policy, "opsd_loss": apart,
        "policy_loss_per_generated_token": F.try_divide(policy, F.size(log_p)), "content_mean_nll": -F.try_divide(total(c), F.size(c)), "report_mean_nll": -F.try_divide(total(r), F.size(r)),
        "content_tokens": F.size(c), "report_tokens": F.size(r),
    }
    return {name: F.when(aligned, x) for name, x in out.items()}


def batch_loss(content_weight: Column, report_weight: Column, content_log_p: Column, report_log_p: Column) -> Column:
    """An aggregate: the mean over rollouts of each segment's negative weight (see sampled_weights) times its sum of log probabilities."""
    return F.avg(-content_weight * total(content_log_p) - report_weight * total(report_log_p))


def rescore_ids(prompt: Column, response: Column) -> tuple[Column, Column]:
    """(sampled ids after the prompt's, place of the first of them); null unless both have ids and none is below 0."""
    fair = (F.size(prompt) > 0) & (F.size(response) > 0) & F.forall(F.concat(prompt, response), lambda x: F.coalesce(x >= 0, F.lit(False)))
    return F.when(fair, F.concat(prompt, response)), F.when(fair, F.size(prompt))


# Agreement of aligned vectors.


def masked_deltas(a: Column, b: Column, mask: Column) -> tuple[Column, Column, Column]:
    """(entries compared, largest, mean absolute difference) where the mask is 1; null differences without entries."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda x: x["m"] == 1)
    deltas = F.transform(pairs, lambda x: F.abs(x["a"] - x["b"]).cast("double"))
    return F.size(deltas), F.array_max(deltas), F.try_divide(total(deltas), F.size(deltas))


def ragged_delta(a: Column, b: Column, length: Column) -> Column:
    """The largest absolute difference over each row's own length."""
    return F.array_max(F.zip_with(F.slice(a, 1, length), F.slice(b, 1, length), lambda x, y: F.abs(x - y)))


def gate(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold, in their order; a null doesn't hold. None left means the gate is open."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in checks.items()]))
