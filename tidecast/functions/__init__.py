"""Column expressions and small helpers: calendar, dates (row-wise parsing), numeric (null-safe math,
engine-neutral rounding), attach (one-row figures as scalar subqueries), text (labels and formats)."""
