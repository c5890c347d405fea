"""Registered plans: each query beside the SQL that it must agree with."""
