"""Quotation detection, verification and correction as Spark DataFrame plans."""
