"""Registered queries: each pairs a Spark plan on the supplied tables with equivalent SQL where one can be written."""
