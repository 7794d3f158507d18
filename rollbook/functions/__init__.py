"""Column helpers: text, postcodes, dates, role lists and string distance."""
