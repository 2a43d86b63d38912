"""The registered queries and the images they run on."""
