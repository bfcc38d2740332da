"""Column-level building blocks: text gates, time bounds, scoring, grading."""
