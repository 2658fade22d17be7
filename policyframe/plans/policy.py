"""Rules of who may read what: ordered grants and denials, later ones first, as row constraints and field masks."""

from __future__ import annotations

from dataclasses import dataclass

from policyframe.plans.predicate import ALL, NONE, And, Condition, Leaf, Not, Or, Related, normalize


class Forbidden(Exception):
    """An action that no rule grants, or a use of a field that the request does not prove to be readable."""


@dataclass(frozen=True)
class Rule:
    action: str
    allow: bool
    where: Condition = ALL
    fields: tuple[str, ...] | None = None


class Rules:
    """A model's rules, in the order of their declaration."""

    def __init__(self, *rules: Rule):
        self.rules = rules

    def can(self, action: str, where: Condition = ALL, fields: tuple[str, ...] | None = None) -> Rules:
        return Rules(*self.rules, Rule(action, True, where, fields))

    def cannot(self, action: str, where: Condition = ALL, fields: tuple[str, ...] | None = None) -> Rules:
        return Rules(*self.rules, Rule(action, False, where, fields))

    def rows(self, action: str) -> Condition:
        """From the last rule to the first: a grant holds where no later denial does. Denials of fields count for no rows."""
        granted: list[Condition] = []
        denied: list[Condition] = []
        for r in reversed([r for r in self.rules if r.action == action]):
            if r.allow:
                granted.append(And((r.where, *map(Not, denied))))
            elif r.fields is None:
                denied.append(r.where)
        return normalize(Or(tuple(granted)))

    def field(self, action: str, name: str) -> Condition:
        """The first rule from the end that names the field, or all fields, and whose condition holds decides."""
        granted: list[Condition] = []
        before: list[Condition] = []
        for r in reversed([r for r in self.rules if r.action == action and (r.fields is None or name in r.fields)]):
            if r.allow:
                granted.append(And((r.where, *map(Not, before))))
            before.append(r.where)
        return normalize(Or(tuple(granted)))


class Policies:
    """Rules by model. Models without rules grant nothing; `None` in place of Policies is the system, which may do all."""

    def __init__(self, rules: dict[str, Rules]):
        self.rules = rules

    def rows(self, model: str, action: str = "read") -> Condition:
        c = self.rules.get(model, Rules()).rows(action)
        if c == NONE:
            raise Forbidden(f"{action} {model}")
        return c

    def field(self, model: str, name: str, action: str = "read") -> Condition:
        return self.rules.get(model, Rules()).field(action, name)


def expand(c: Condition, model, catalog, policies: Policies | None, under: tuple[str, ...] = ()) -> Condition:
    """Relations see only targets that the policy shows; policies that lead back to themselves are refused."""
    if policies is None or isinstance(c, Leaf):
        return c
    if isinstance(c, And | Or):
        return type(c)(tuple(expand(p, model, catalog, policies, under) for p in c.parts))
    if isinstance(c, Not):
        return Not(expand(c.part, model, catalog, policies, under))
    if not isinstance(c, Related):
        return c
    target = catalog.model(model.relation(c.relation).target)
    inner = expand(c.part, target, catalog, policies, under)
    visible = visible_rows(target, catalog, policies, under)
    if c.op == "every":
        return Related(c.relation, "none", normalize(And((visible, Not(inner)))))
    if c.op in ("rel_is_null", "rel_is_not_null"):
        return Related(c.relation, "none" if c.op == "rel_is_null" else "some", visible)
    return Related(c.relation, c.op, normalize(And((visible, inner))))


def visible_rows(model, catalog, policies: Policies | None, under: tuple[str, ...] = ()) -> Condition:
    if policies is None:
        return ALL
    if model.name in under:
        raise ValueError(f"policies of {' -> '.join((*under, model.name))} lead back to themselves")
    return normalize(expand(policies.rows(model.name), model, catalog, policies, (*under, model.name)))
