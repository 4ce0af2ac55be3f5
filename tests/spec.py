"""Plain Python statements of what operators must return, used as brute-force checks on small data."""

from __future__ import annotations

from fractions import Fraction


def boxed(text: str, start: int):
    """Content of the brace opened right before ``start``."""
    depth = 1
    for i in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start:i].strip()
    return None


def first_box(text):
    if text is None:
        return None
    text = text.split("</think>")[-1]
    at = text.find("\\boxed{")
    return None if at < 0 else boxed(text, at + 7)


def last_box(text):
    if text is None:
        return None
    at = text.rfind("\\boxed")
    return boxed(text, at + 7) if at >= 0 and text[at + 6 : at + 7] == "{" else None


def key(answer):
    """Equivalence key of the notations the tests use."""
    if not answer or not answer.strip():
        return None
    bare = "".join(answer.split())
    try:
        if ":" in bare:
            top, bottom = bare.split(":")
        elif bare.startswith("\\frac{"):
            top, bottom = bare[6:-1].split("}{")
        else:
            top, bottom = bare, "1"
        return round(float(Fraction(top) / Fraction(bottom)), 6)
    except (ValueError, ZeroDivisionError):
        return bare.lower()


def vote(answers):
    """Label, key and size of the winning group: count, then shorter text, then first seen."""
    groups = {}
    for a in answers:
        if key(a) is not None:
            groups.setdefault(key(a), []).append(a)
    if not groups:
        return None, None, 0
    winner = None
    for k, members in groups.items():
        if winner is None or (len(members), -len(members[0].strip())) > (len(groups[winner]), -len(groups[winner][0].strip())):
            winner = k
    return groups[winner][0], winner, len(groups[winner])


def class_sizes(k, n_pos, n_neg, fraction):
    """How many of each class: of all splits that use as many rows as possible, the one nearest to the wanted share.

    ``fraction`` -1 shares by the square roots of the class sizes and leaves no class out that has members.
    """
    total = min(k, n_pos + n_neg)
    splits = [(p, total - p) for p in range(total + 1) if p <= n_pos and total - p <= n_neg]
    if fraction != -1:
        return min(splits, key=lambda s: abs(s[0] - round(k * fraction)))
    if n_pos and n_neg and k > 1:
        splits = [s for s in splits if min(s) >= 1]
    if n_pos and k == 1:
        return 1, 0
    roots = (n_pos**0.5 + n_neg**0.5) or 1
    return min(splits, key=lambda s: abs(s[1] - round(k * n_neg**0.5 / roots)))


def picks(pos, neg, k, fraction):
    """Chosen members of two ranked classes, positives first."""
    n_pos, n_neg = class_sizes(k, len(pos), len(neg), fraction)
    return pos[:n_pos] + neg[:n_neg]


#: Per strategy what puts a row in front: the largest tuple wins, equal ones go by the order of sampling.
PREFERS = {
    0: lambda r: (bool(r["answer"]), -r["n_tokens"]),
    1: lambda r: (r["kl_score"], -r["n_tokens"]),
    2: lambda r: (r["logp_score"], -r["n_tokens"]),
    3: lambda r: (bool(r["answer"]), r["n_tokens"]),
}


def ranked(rows, strategy):
    """Best first; an unknown strategy keeps the order of sampling."""
    by_time = sorted(rows, key=lambda r: r["rollout_idx"])
    return sorted(by_time, key=PREFERS.get(strategy, lambda r: 0), reverse=True) if strategy in PREFERS else by_time


def select(rows, k, fraction, pos_strategy, neg_strategy, threshold):
    """Rows of one prompt -> (rollout_idx, sign) in selection order, put together from the classes a row can be in."""
    in_time = ranked(rows, None)
    label, label_key, size = vote([r["answer"] for r in in_time])
    voted = bool(label) and size >= threshold
    sides = {True: [], False: []}
    for r in in_time:
        sides[voted and bool(r["answer"]) and key(r["answer"]) == label_key].append(r)
    if fraction == -2:
        out = in_time[:k]
    elif voted:
        out = picks(ranked(sides[True], pos_strategy), ranked(sides[False], neg_strategy), k, fraction)
    else:
        out = ranked(in_time, pos_strategy)[:k]
    good = {r["rollout_idx"] for r in sides[True]}
    if not voted:  # the shortest answered one stands in for the positives
        answered = [(r["n_tokens"], place, r["rollout_idx"]) for place, r in enumerate(out) if r["answer"]]
        good = {min(answered)[2]} if answered else set()
    return [(r["rollout_idx"], 1 if r["rollout_idx"] in good else -1) for r in out]
