"""Reading and writing tables, and what is known about them."""
