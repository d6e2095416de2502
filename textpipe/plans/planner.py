"""From a configuration to steps: order, refusals of continuous runs, fusion."""

from __future__ import annotations

from dataclasses import dataclass

from .config import Config, ConfigError, Operation


@dataclass(frozen=True)
class Step:
    """A single operation, or a run of them that is done at once."""

    operations: tuple[Operation, ...]
    fused: bool = False

    @property
    def label(self) -> str:
        return "+".join(o.name for o in self.operations)


#: Runs of operations that are done at once, longest first.
_FUSIBLE = (
    ("collapse_whitespace", "trim_trailing_whitespace", "remove_blank_lines", "dedupe_lines"),
    ("collapse_whitespace", "trim_trailing_whitespace", "remove_blank_lines"),
    ("trim_trailing_whitespace", "remove_blank_lines", "dedupe_lines"),
    ("trim_trailing_whitespace", "remove_blank_lines"),
    ("strip_html", "strip_markdown"),
)


def plan(config: Config, continuous: bool = False, fuse: bool = True) -> list[Step]:
    """Steps in the order in which they run; a continuous run refuses reductions."""
    config.validate()
    operations = config.ordered()
    if continuous and (refused := [o.name for o in operations if o.spec.reduction]):
        raise ConfigError("reduction", f"a continuous run can't apply {', '.join(refused)}")
    steps, at = [], 0
    while at < len(operations):
        names = [o.name for o in operations[at:]]
        run = next((f for f in _FUSIBLE if fuse and tuple(names[: len(f)]) == f), None)
        n = len(run) if run else 1
        steps.append(Step(tuple(operations[at : at + n]), run is not None))
        at += n
    return steps
