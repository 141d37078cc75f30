"""Occupation-exposure transfer, roll-up and panel estimation as Spark DataFrame operators."""
