"""How a threshold join is carried out."""
