"""Where images come from and where edited ones go."""
