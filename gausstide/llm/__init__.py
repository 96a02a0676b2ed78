"""Training-data operators (ten operators, their queries and SQL); nothing else in the library imports this package."""
