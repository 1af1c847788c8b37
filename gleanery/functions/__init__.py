"""Column expressions: dates, JSON label arrays, text clean-up, labels and set measures."""
