"""Arithmetic of training plans: parameters, memory, schedules, budgets, the ladder of candidates."""
