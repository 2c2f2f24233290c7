"""Order, schedule and control of calls."""
