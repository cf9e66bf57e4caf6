"""Training-data operators: whole-corpus filters, joins, learners and packing."""
