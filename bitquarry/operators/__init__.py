"""Relational operators by bit distance: filters, joins, nearest neighbours, windows."""
