"""Attestry: question-answering quality, safety and audit analytics as PySpark DataFrame transforms."""
