"""Operators over whole tables: ordered folds, joins, the policy chain, and reports."""
