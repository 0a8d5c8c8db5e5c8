"""Reading and writing route documents and the tables derived from them."""
