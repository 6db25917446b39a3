"""loomgraph: text tables to labelled graphs, count matrices and statistics, as DataFrame operators."""
