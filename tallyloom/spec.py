"""Dataset specifications: what differs between activity logs."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Sentinel strings that mean a missing object, seeds and split shares.
MISSING = ("", "na", "n/a", "none", "null", "no data", "-")
SEEDS = (1, 11, 111, 1111, 11111)
TEST_SHARE = 0.30
VALIDATION_SHARE = 0.10 / (0.60 + 0.10)  # of the rest, as a double: slightly over one seventh

FAMILIES = ("course", "object", "user", "self_loop")


@dataclass(frozen=True)
class Spec:
    """actions: column order of the per-action counts; object_actions: action to object family; weighted: clicks are summed.

    groups: the actions by group, whose features are numbered from 1 in each; without them features bear the action's name."""

    name: str
    window: int
    actions: tuple[str, ...]
    object_actions: dict[str, str] = field(default_factory=dict)
    weighted: bool = False
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        day, total, objects, action = (
            ("clicks_day", "total_clicks", "distinct_sites", "clicks") if self.weighted else ("activity_day", "total_events", "distinct_objects", "action")
        )
        named = [f"{g}_{k}" for g, own in self.groups.items() for k in range(1, len(own) + 1)] or [a.lower() for a in self.actions]
        return [*(f"{day}_{d}" for d in range(self.window)), total, objects, *(f"{action}_{a}" for a in named)]


EVENTS = Spec("events", 21, ("click", "error", "purchase", "signup", "view"), {"view": "view", "click": "click", "purchase": "purchase"})
ORDERS = Spec("orders", 35, ("AF", "AO", "NF", "NO", "RF", "RO"), {a: a for a in ("AF", "AO", "NF", "NO", "RF", "RO")}, weighted=True)


#: The actions of the public MOOC drop-out log, by group; web pages are no objects.
MOOC_GROUPS = {
    "video": ("seek_video", "play_video", "pause_video", "stop_video", "load_video"),
    "assignment": ("problem_get", "problem_check", "problem_save", "reset_problem", "problem_check_correct", "problem_check_incorrect"),
    "forum": ("create_thread", "create_comment", "delete_thread", "delete_comment", "close_forum"),
    "web_page": ("click_info", "click_courseware", "click_about", "click_forum", "click_progress", "close_courseware"),
}
MOOC = Spec(
    "mooc", 35, tuple(a for own in MOOC_GROUPS.values() for a in own),
    {a: g for g, own in MOOC_GROUPS.items() for a in own if g != "web_page"}, groups=MOOC_GROUPS,
)
#: The activity types of the open university's click log.
VLE_TYPES = (
    "dataplus", "dualpane", "externalquiz", "forumng", "glossary", "homepage", "htmlactivity", "oucollaborate", "oucontent",
    "ouelluminate", "ouwiki", "page", "questionnaire", "quiz", "resource", "sharedsubpage", "subpage", "url",
)
VLE = Spec("vle", 35, VLE_TYPES, {a: a for a in VLE_TYPES}, weighted=True)


@dataclass(frozen=True)
class Scenario:
    """One ablation: which edge families, how many graph layers, which branches."""

    code: str
    families: tuple[str, ...] = FAMILIES
    layers: int = 2
    mlp: bool = True
    hgnn: bool = True
    learn_w: bool = True
    shuffle: bool = False
    causal: bool = False


def _without(*gone: str) -> tuple[str, ...]:
    return tuple(f for f in FAMILIES if f not in gone)


#: The scenario catalogue, in report order.
SCENARIOS = {
    s.code: s
    for s in (
        Scenario("M"),
        Scenario("A1", _without("course")),
        Scenario("A2", _without("object")),
        Scenario("A3", _without("user")),
        Scenario("A4", _without("self_loop")),
        Scenario("W1", learn_w=False),
        Scenario("L1", layers=1),
        Scenario("L3", layers=3),
        Scenario("H", mlp=False),
        Scenario("P0", (), 0, hgnn=False, learn_w=False),
        Scenario("S1", shuffle=True),
        Scenario("C1", ("course", "self_loop")),
        Scenario("O1", ("object", "self_loop")),
        Scenario("U1", ("user", "self_loop")),
        Scenario("UC", causal=True),
        Scenario("X1", ("self_loop",)),
    )
}
ALL = ("M", "A1", "A2", "A3", "A4", "W1", "L1", "H")


def scenario_codes(values: list[str]) -> list[str]:
    """Expands ``all`` and rejects unknown codes."""
    out = [c for v in values for c in (ALL if v == "all" else (v,))]
    unknown = sorted(set(out) - SCENARIOS.keys())
    if unknown:
        raise ValueError(f"unknown scenarios: {', '.join(unknown)}")
    return list(dict.fromkeys(out))
