"""Operators on points, edges, trees and labels."""
