"""Small source files used by several tests."""

COUNTER_CS = """using System;
using System.Text;
using system;

namespace Samples.Basics;

public class Counter
{
    public int Total { get; set; } = 0;

    public int Bump(int step)
    {
        Total += step;
        return Total;
    }

    public string Render()
    {
        if (Total > 0) { return "}"; }
        return "none";
    }
}
"""

SHAPES_CS = """namespace Samples.Basics;

public interface IShape
{
    double Area();
}

public sealed class Square : IShape, IDisposable
{
    public double Side { get; set; }

    public double Area()
    {
        return Side * Side;
    }
}

public enum Mood
{
    Calm,
    Loud
}
"""

CALLS_CS = """using Samples.Basics;

namespace Samples.Use;

public class Runner
{
    public void Go()
    {
        var counter = new Counter();
        var text = counter.Render();
        var square = new Square();
        var size = square.Area();
    }
}
"""

MAIN_RS = """mod store;
mod model;

use crate::store::basket::{add_item, drop_item};
use crate::model::item::Item;

fn main() {
    let item = add_item(3);
    let gone = drop_item(&item); // add_item(4)
}
"""

BASKET_RS = """use crate::model::item::{Item, Shade as Tone};

pub fn add_item(id: u32) -> Item {
    Item::fresh(id)
}

pub fn drop_item(item: &Item) -> Tone {
    Tone::Dark
}
"""

ITEM_RS = """pub struct Item {
    pub id: u32,
}

pub enum Shade {
    Dark,
    Light,
}

pub trait Named {
    fn name(&self) -> String;
}

impl Item {
    pub fn fresh(id: u32) -> Self {
        Item { id }
    }
}

impl Named for Item {
    fn name(&self) -> String {
        String::new()
    }
}

pub mod inner {
    pub fn helper() {}
}
"""

LIB_RS = """pub struct Settings {
    pub level: u32,
}

pub fn load_settings() -> Settings {
    Settings { level: 1 }
}
"""

APP_RS = """use base_kit::load_settings;
use base_kit::Settings;

fn main() {
    let s: Settings = load_settings();
}
"""

SHOP_TOML = '[package]\nname = "shop"\nversion = "0.1.0"\n'
SPACE_TOML = '[workspace]\nmembers = ["base-kit", "apps/*"]\n'
BASE_TOML = '[package]\nname = "base-kit"\nversion = "0.1.0"\n'
APP_TOML = '[package]\nname = "front"\nversion = "0.1.0"\n\n[dependencies]\nbase-kit = { path = "../../base-kit" }\nserde = "1"\n'

FILES = [
    ("cs", "/r/Counter.cs", COUNTER_CS), ("cs", "/r/Shapes.cs", SHAPES_CS), ("cs", "/r/Calls.cs", CALLS_CS),
    ("rs", "/s/Cargo.toml", SHOP_TOML), ("rs", "/s/src/main.rs", MAIN_RS), ("rs", "/s/src/store/basket.rs", BASKET_RS), ("rs", "/s/src/model/item.rs", ITEM_RS),
    ("ws", "/w/Cargo.toml", SPACE_TOML), ("ws", "/w/base-kit/Cargo.toml", BASE_TOML), ("ws", "/w/base-kit/src/lib.rs", LIB_RS),
    ("ws", "/w/apps/front/Cargo.toml", APP_TOML), ("ws", "/w/apps/front/src/main.rs", APP_RS),
]


def files_df(spark):
    return spark.createDataFrame(FILES, "repo_name string, file_path string, content string")
