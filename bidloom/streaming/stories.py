"""What a job's events tell, whatever their order: a small state that merges event by event."""

from __future__ import annotations

from dataclasses import dataclass, field

#: States a job stays in.
ENDED = ("done", "failed")
STATE = "end_at long, end_status string, last_at long, running boolean, progress array<int>, since array<long>, begins array<long>, ends array<long>, timer long, told string, changes int"


@dataclass
class Story:
    """Times are whole microseconds.

    end: the earliest report of an end. progress and since: each progress that was higher
    than all told before it, with the earliest time it was told; at most one entry a
    percent. begins and ends: the times between which a running job was heard of without
    a silence longer than ``stuck``; at most the horizon of lateness by ``stuck`` of them
    are ever open.
    """

    end_at: int | None = None
    end_status: str | None = None
    last_at: int | None = None
    running: bool = False
    progress: list[int] = field(default_factory=list)
    since: list[int] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    #: When the watermark decides the job's end or its keeping ends, in milliseconds.
    timer: int | None = None
    #: What was last put out.
    told: str | None = None
    changes: int = 0

    @classmethod
    def of(cls, row) -> Story:
        story = cls(*row) if row is not None else cls()
        for name in ("progress", "since", "begins", "ends"):
            setattr(story, name, list(getattr(story, name) or []))
        story.running, story.changes = bool(story.running), story.changes or 0
        return story

    def row(self) -> tuple:
        return tuple(vars(self).values())

    def add(self, at: int, status: str, progress: int | None, stuck: int) -> None:
        self.last_at = at if self.last_at is None else max(self.last_at, at)
        if progress is not None:
            steps = sorted([*zip(self.since, self.progress), (at, progress)], key=lambda s: (s[0], -s[1]))
            self.since, self.progress = [], []
            for t, p in steps:
                if not self.progress or p > self.progress[-1]:
                    self.since.append(t)
                    self.progress.append(p)
        if status in ENDED and (self.end_at is None or (at, status) < (self.end_at, self.end_status)):
            self.end_at, self.end_status = at, status
        if status == "running":
            self.running = True
            spans = sorted([*zip(self.begins, self.ends), (at, at)])
            self.begins, self.ends = [], []
            for begin, end in spans:
                if self.ends and begin <= self.ends[-1] + stuck:
                    self.ends[-1] = max(self.ends[-1], end)
                else:
                    self.begins.append(begin)
                    self.ends.append(end)

    def now(self, watermark: int, stuck: int) -> tuple[str, int, int, bool]:
        """Status, progress, the time of the last change, and whether no event can change it any more."""
        silent = self.ends[0] + stuck if self.ends else None
        told = self.end_at is not None and (silent is None or self.end_at <= silent)
        if told or self.end_at is not None and silent >= watermark:
            status, at, final = self.end_status, self.end_at, told and self.end_at < watermark
        elif silent is not None and silent < watermark:
            status, at, final = "failed", silent, True
        else:
            return "running" if self.running else "pending", max(self.progress, default=0), self.last_at, False
        return status, 100 if status == "done" else max((p for p, t in zip(self.progress, self.since) if t <= at), default=0), at, final

    def deadline(self, stuck: int) -> int | None:
        """The earliest time at which the watermark decides the job's end."""
        return min([t for t in (self.end_at, self.ends[0] + stuck if self.ends else None) if t is not None], default=None)
