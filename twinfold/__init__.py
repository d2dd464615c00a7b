"""Paired-counterfactual analytics as Spark DataFrame plans."""
