"""End-to-end plans: training, scoring the next session, search, reports."""
