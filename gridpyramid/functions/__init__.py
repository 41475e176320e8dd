"""Part of gridpyramid; see the README for the layout."""
