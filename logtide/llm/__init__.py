"""Operators of a training-data pipeline: each works on whole tables and texts, in tasks of bounded memory."""
