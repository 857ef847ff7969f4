"""Ticket priority audit on Spark: clean, score, fuse, label, explain, measure."""
