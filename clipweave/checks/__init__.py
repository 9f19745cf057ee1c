"""Correctness checks: derived inputs, one query per operator and its SQL twin."""
