"""Résumé intake, enrichment, matching and market analytics as Spark DataFrame operators."""
