"""Operators for preparing training data: filtering, matching, counting, mixing and storing documents.

Nothing outside this subpackage imports it. ``queries.py`` registers one query per operator.
"""
