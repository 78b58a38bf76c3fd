"""A generalised LL recogniser with a graph-structured stack.

Any context-free grammar will do, ambiguous and left-recursive ones included: all alternatives are followed at once, calls of
one nonterminal at one position share a node of the stack, and each node remembers where it ended, so that later callers take
those ends over without parsing again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

Rules = dict[str, list[tuple[str, ...]]]


class Recogniser:
    """rules: alternatives by nonterminal; a symbol without a rule is a terminal, tested by ``match(terminal, token)``."""

    def __init__(self, rules: Rules, match: Callable[[str, tuple], bool]):
        self.rules, self.match = rules, match

    def ends(self, start: str, tokens: Sequence[tuple], at: int) -> set[int]:
        """Every position at which ``start``, begun at ``at``, may end; empty if it can't be found there."""
        rules, match, n = self.rules, self.match, len(tokens)
        root = (start, at)
        callers: dict[tuple, list[tuple]] = {root: []}
        ended: dict[tuple, set[int]] = {root: set()}
        todo = [(alt, 0, root, at) for alt in rules[start]]
        seen = set()
        while todo:
            step = todo.pop()
            if step in seen:
                continue
            seen.add(step)
            alt, dot, node, pos = step
            while dot < len(alt):
                symbol = alt[dot]
                if symbol in rules:
                    break
                if pos >= n or not match(symbol, tokens[pos]):
                    dot = -1
                    break
                dot, pos = dot + 1, pos + 1
            if dot < 0:
                continue
            if dot == len(alt):
                if pos not in ended[node]:
                    ended[node].add(pos)
                    todo += [(a, d, caller, pos) for a, d, caller in callers[node]]
                continue
            called = (alt[dot], pos)
            back = (alt, dot + 1, node)
            if called not in callers:
                callers[called], ended[called] = [back], set()
                todo += [(a, 0, called, pos) for a in rules[alt[dot]]]
            elif back not in callers[called]:
                callers[called].append(back)
                todo += [(*back, end) for end in ended[called]]
        return ended[root]
