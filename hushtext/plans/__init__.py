"""Whole experiments: sanitize and evaluate documents under a sweep of privacy budgets."""
