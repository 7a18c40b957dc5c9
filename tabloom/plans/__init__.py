"""The lazy view: a plan over one DataFrame."""
