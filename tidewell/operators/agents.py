"""Control loops around a language model, which is any callable: budgets, validation, forced answers. Nothing here needs a network; tests use scripted models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

#: Tool calls of each kind of agent, and tries at a final answer.
BUDGETS = {"investigator": 10, "faults": 12, "onboarding": 30, "decision": 1}
SUBMIT_TRIES = 3

Chat = Callable[[list[dict]], dict]


@dataclass
class Outcome:
    answer: dict | None
    calls: int
    transcript: list[dict] = field(default_factory=list)
    reason: str = "submitted"


def strip_fences(text: str) -> str:
    """What a model wrote without the fences of a code block."""
    found = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return (found[1] if found else text).strip()


def parse_json(text: str) -> dict | None:
    try:
        out = json.loads(strip_fences(text))
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def valid_ranking(text: str, n: int) -> tuple[list[int] | None, str]:
    """A permutation of candidate numbers 0 to n - 1 from a model's answer, else None and why."""
    got = parse_json(text)
    if got is None:
        return None, "not JSON"
    order = got.get("ranking")
    if not isinstance(order, list) or not all(isinstance(i, int) and not isinstance(i, bool) for i in order):
        return None, "no list of numbers"
    if sorted(order) != list(range(n)):
        return None, "not a permutation of the candidates"
    return order, "ok"


def rerank(candidates: Sequence[dict], chat: Chat, repeats: int = 1) -> tuple[list[dict], str]:
    """Candidates in the model's order; with repeats, by votes (first place counts most); in their own order where no answer is valid, with the reason."""
    prompt = [{"role": "user", "content": json.dumps({"candidates": [{"index": i, **c} for i, c in enumerate(candidates)], "answer": {"ranking": "indices, best first"}})}]
    votes, reason = [], "no answer"
    for _ in range(repeats):
        try:
            order, reason = valid_ranking(chat(prompt).get("content", ""), len(candidates))
        except Exception as error:  # noqa: BLE001  (whatever the model's client raises: quota, time, connection)
            order, reason = None, f"{type(error).__name__}: {error}"
        if order:
            votes.append(order)
    if not votes:
        return list(candidates), f"fallback: {reason}"
    mean = {i: sum(v.index(i) for v in votes) / len(votes) for i in range(len(candidates))}
    return [candidates[i] for i in sorted(mean, key=lambda i: (mean[i], i))], "ok"


def run(chat: Chat, tools: Mapping[str, Callable[..., object]], task: str, budget: int, check: Callable[[dict], str | None]) -> Outcome:
    """Ask, call the tool that is named, answer with its result, until the model submits an answer that `check` has nothing against (it returns what is wrong, or None).

    A reply is {"tool": name, "args": {...}} or {"submit": {...}}; others are nudged. At the end of the budget only submitting is allowed.
    """
    messages, out, tries = [{"role": "user", "content": task}], Outcome(None, 0), 0
    for _ in range(2 * budget + 2 * SUBMIT_TRIES):
        if out.calls >= budget:
            messages.append({"role": "user", "content": "No tool calls are left. Submit your answer."})
        reply = chat(messages)
        messages.append({"role": "assistant", "content": json.dumps(reply, default=str)})
        if isinstance(reply.get("submit"), dict):
            tries += 1
            wrong = check(reply["submit"])
            if wrong is None:
                out.answer = reply["submit"]
                break
            if tries >= SUBMIT_TRIES:
                out.reason = f"invalid answer: {wrong}"
                break
            messages.append({"role": "user", "content": f"Your answer is not valid: {wrong}"})
        elif reply.get("tool") and out.calls < budget:
            out.calls += 1
            messages.append({"role": "tool", "content": _fitted(_call(tools, reply))})
        else:
            messages.append({"role": "user", "content": "Reply with a tool call or a submission."})
    else:
        out.reason = "no submission"
    out.transcript = messages
    return out


#: Most characters of a tool's result that a model is shown.
SHOWN = 4000


def _fitted(result: object) -> str:
    """A result as JSON; of a list too long to be shown, as many first rows as fit, and how many there were."""
    text = json.dumps(result, default=str)
    if len(text) <= SHOWN or not isinstance(result, list):
        return text
    n = len(result)
    while n and len(text) > SHOWN:
        n -= 1
        text = json.dumps({"rows": result[:n], "of": len(result)}, default=str)
    return text


def _call(tools: Mapping[str, Callable[..., object]], reply: dict) -> object:
    tool = tools.get(reply["tool"])
    if tool is None:
        return {"error": f"unknown tool {reply['tool']!r}; there are {sorted(tools)}"}
    try:
        return tool(**reply.get("args", {}))
    except (TypeError, ValueError) as error:
        return {"error": str(error)}
