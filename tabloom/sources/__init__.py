"""Reading sources into views and saving views."""
